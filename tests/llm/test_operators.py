"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and
columns whose names clash; and against plain Python on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from packfold.llm import (
    bagminhash, bpe, chatformat, components, decontaminate, lyndon, repeats, resampling, rules, secrets, texts, toxicity, units,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "key string, hash long, row long, score double, predicted int, spans string, _text string, _row long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def sentence(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa".split()) + rnd.choice(["", "s", "."]) for _ in range(n))


LONG = "\n".join(sentence(s, 40) for s in range(1500))
ROWS = [
    (1, sentence(1, 120), "en"),
    (2, sentence(1, 120), "en"),
    (3, sentence(1, 110) + " " + sentence(3, 10), "fr"),
    (4, "", "en"),
    (5, None, None),
    (6, LONG, "en"),
    (7, "Alpha beta, ALPHA beta!\n\n  \t", None),
    (8, sentence(8, 200), "de"),
    (8, sentence(8, 200), "de"),
    (9, sentence(9, 60) + "\n" + sentence(50, 60) + "\n" + sentence(10, 30), "en"),
    (10, sentence(11, 30) + "\n" + sentence(50, 60), "en"),
    (None, sentence(12, 80), "en"),
    (None, None, None),
    (11, "one", "en"),
    (12, "x" * 900, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "s", len(t or ""), "k", 1, 2, 0.5, 1, "a", "b", 3) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 13)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def keys(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.select(df.columns[0]).collect())


ALL_KEYS = sorted((i is None, i or 0) for i, _, _ in ROWS)


# -- kernels ----------------------------------------------------------------------------------


def test_runs_and_hashes_match_a_regex():
    rnd = random.Random(0)
    column = pa.array([None if rnd.random() < 0.1 else "".join(rnd.choices("ab é\n.x", k=rnd.randrange(12))) for _ in range(500)])
    seen = {}
    for size in (1, 50, 1 << 20):
        got = [[] for _ in column]
        for block in texts.blocks(column, size):
            found = texts.runs(block, texts.SPACED)
            hashes = texts.slice_hash(texts.prefix_hash(block.data), found.start, found.end)
            for t, a, b, h in zip(found.text, found.start, found.end, hashes):
                word = bytes(block.data[a:b]).decode()
                got[block.first + t].append(word)
                assert seen.setdefault(word, h) == h
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in column.to_pylist()]
    assert len(set(seen.values())) == len(seen)


def test_suffix_array_sorts():
    rnd = random.Random(1)
    for _ in range(800):
        n, k = rnd.randrange(1, 50), rnd.choice([1, 2, 3, 9])
        word = [rnd.randrange(1, k + 1) for _ in range(n)]
        word = (word[: n // 3 + 1] * 4)[:n] + [0] if rnd.random() < 0.4 else [*word, 0]
        assert lyndon.suffix_array(np.array(word)).tolist() == sorted(range(len(word)), key=lambda i: word[i:])


# -- 1 resampling -----------------------------------------------------------------------------


def test_kth_largest(spark):
    rnd = random.Random(2)
    values = [rnd.choice([-1.5, 0.0, 3.25, rnd.gauss(0, 1e6)]) for _ in range(300)]
    df = spark.createDataFrame([(int(v),) for v in resampling.sortable(np.array(values))], "v long")
    ordered = sorted(resampling.sortable(np.array(values)).tolist(), reverse=True)
    for k in (1, 7, 300):
        assert resampling.kth_largest(df, "v", k) == ordered[k - 1]
    assert resampling.kth_largest(df, "v", 301) is None


def test_resampling_prefers_the_target_and_keeps_the_share(spark, docs, empty, labels):
    rows = [(i, sentence(i, 50) if i % 3 else "junk $$ " * 40) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("good", F.col("doc_id") % 3 > 0)
    got = {r.doc_id: r for r in resampling.resample(df, "good", 0.5).collect()}
    kept = [i for i, r in got.items() if r.kept]
    assert len(kept) == 150 and all(i % 3 for i in kept)
    marked = resampling.target_marks(docs, labels, F.col("quality") == 1, 5)
    out = resampling.resample(marked, "_target", 0.5)
    assert keys(out) == ALL_KEYS
    assert all(not r.kept and r.log_weight is None for r in out.filter("n_ngrams = 0").collect())
    assert resampling.resample(empty.withColumn("good", F.lit(True)), "good", 0.5).count() == 0


# -- 2 secrets --------------------------------------------------------------------------------

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def known_forms(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text, re.A) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark, docs, empty):
    rnd = random.Random(4)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = lambda k, a=b64: "".join(rnd.choices(a, k=k))
    bits = ['Token = "', "secret=", "token: ab ", "API_key:'", "apikey =abcdefgh ", "AKIA", "AKIAAKIA", "é", "\n", " x ", "0123456789abcdef", "PASSWORD=passwd=", "deadbeef", "ABCDEFGH1234567890", "-._=", "word "]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randrange(12)))) for i in range(300)]
    planted = {1000 + i: f"see {noise(rnd.choice([44, 64]))} now" for i in range(20)}
    plain = {2000 + i: f"see {'this_is_an_ordinary_long_name_of_things_in_the_program'[: 30 + i % 24]} now" for i in range(200)}
    df = spark.createDataFrame(rows + list(planted.items()) + list(plain.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secrets(df, ["doc_id"]).select("doc_id", secrets.told(F.col("spans"), secrets.KINDS[:3]).alias("base"), "spans").collect()}
    for i, text in rows:
        assert got[i].base == known_forms(text), text
    assert sum(any(s.kind == "random" for s in got[i].spans) for i in planted) >= 18
    assert not any(got[i].spans for i in plain)
    out = secrets.secrets(docs, docs.columns, output="found")
    assert keys(out) == ALL_KEYS and out.columns == [*docs.columns, "found"]
    assert secrets.secrets(empty, ["doc_id"]).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([("é password=abcdefabcdef0123456789 end", 1), ("clean", 2), (None, 3)], "text string, doc_id long")
    out = secrets.secrets(df, ["doc_id", "text"]).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in out.collect()} == {1: "é [secret] end", 2: "clean", 3: None}


# -- 3 rules ----------------------------------------------------------------------------------


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_rules(spark, docs, empty):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choices(["a ", "b c d e f ", "é# ", "\n", "\t", "x\n", " ", "$"], k=rnd.randrange(60))), "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counted(text)
        assert not (r.kept and r.base_failed)
    out = rules.quality_rules(docs)
    assert keys(out) == ALL_KEYS
    assert not any(r.kept for r in out.filter("n_words = 0").collect())
    assert rules.quality_rules(empty).count() == 0


def prose(words, n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", "."]) for _ in range(n))


ENGLISH = [w + e for w in "the of and to in house water green people morning story field".split() for e in ("", "s", "ly", "ed")]
GREEK = [w + e for w in "και του στην νερό σπίτι πράσινο άνθρωπος πρωί ιστορία πεδίο".split() for e in ("", "ς", "ν")]


@pytest.mark.parametrize("near", [1_000, 1])
def test_a_rare_language_is_never_judged_by_another(spark, monkeypatch, near):
    """Whether its rows are kept does not hang on how much other text there is."""
    monkeypatch.setattr(rules, "MIN_REFERENCE_WORDS", 1_500)
    monkeypatch.setattr(rules, "NEAR_LANGUAGES", near)
    greek = [(i, prose(GREEK, 100, i), "el") for i in range(20)]
    odd = [(900, prose(GREEK, 120, 900), "en"), (901, prose(ENGLISH, 120, 901), "el"), (902, prose(ENGLISH, 120, 902), "xx"), (903, prose(GREEK, 120, 903), None)]
    for n in (100, 2_000):
        rows = greek + odd + [(1000 + i, prose(ENGLISH, 60, 10_000 + i), "en") for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
        got = {r.doc_id: r for r in rules.quality_rules(df).collect()}
        assert len(got) == len(rows) and all(got[i].kept or got[i].base_failed for i, *_ in greek)
        assert sum(got[i].kept for i, *_ in greek) >= 18
        assert got[900].class_distance > 0.5 and not got[900].kept and not got[901].kept
        assert got[902].class_distance is None and got[903].word_distance is None
        assert got[902].kept != got[902].base_failed and got[903].kept != got[903].base_failed


@pytest.mark.parametrize("near", [1_000, 1])
def test_distances_against_plain_python(spark, monkeypatch, near):
    from collections import Counter
    from math import log2, sqrt

    monkeypatch.setattr(rules, "MIN_REFERENCE_WORDS", 300)
    monkeypatch.setattr(rules, "NEAR_LANGUAGES", near)
    monkeypatch.setattr(rules, "COMMON_WORDS", 7)
    rows = [(i, prose(ENGLISH if i % 2 else GREEK, 5 + i % 90, i) + ["", " 12,5 $x", "\nA B"][i % 3], ("en", "el")[i % 2]) for i in range(120)]
    rows += [(500, "few words", "de"), (501, None, "en"), (502, "", "el")]
    spans = {0: "abcdefghijklmnopqrstuvwxyz", 1: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: "0123456789", 3: " \t\n\v\f\r", 4: ".,;:!?'\"-()", 6: "#*$%&|<>@^_~=+/\\{}[]`"}

    def kind(c):
        b = c.encode()
        return 7 if 0xC0 <= b[0] < 0xE0 else 8 if b[0] >= 0xE0 else next((k for k, chars in spans.items() if c in chars), 5)

    def words(t):
        return (t or "").split()

    def distance(p, q):
        total = lambda x: max(sum(x.values()), 1e-300)
        p, q = {k: v / total(p) for k, v in p.items()}, {k: v / total(q) for k, v in q.items()}
        half = lambda a, b: sum(v * log2(v / ((v + b.get(k, 0)) / 2)) for k, v in a.items() if v)
        return sqrt(min(max((half(p, q) + half(q, p)) / 2, 0), 1))

    texts_of, refs = {}, {}
    for _, t, lang in rows:
        texts_of.setdefault(lang, []).append(t or "")
    for lang, own in texts_of.items():
        n = Counter(w for t in own for w in words(t))
        if sum(n.values()) >= 300:
            hashed = lambda w: int(texts.slice_hash(texts.prefix_hash(np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(w.encode())]))[0].view(np.int64))
            top = sorted(n, key=lambda w: (-n[w], hashed(w)))[:7]
            refs[lang] = (Counter(kind(c) for t in own for c in t), Counter({w: n[w] for w in top}) + Counter({None: sum(n.values()) - sum(n[w] for w in top)}), set(top))
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert set(refs) == {"en", "el"}
    for i, t, lang in rows:
        r = got[i]
        if lang not in refs:
            assert r.class_distance is None and r.word_distance is None
            continue
        classes, common, top = refs[lang]
        by_class = distance(Counter(kind(c) for c in t or ""), classes)
        by_word = distance(Counter(w if w in top else None for w in words(t)), common)
        assert abs(r.class_distance - by_class) < 1e-9 and abs(r.word_distance - by_word) < 1e-9, i
        odd = len(t or "") >= rules.MIN_CHARACTERS and by_class > rules.MAX_CLASS_DISTANCE or len(words(t)) >= rules.MIN_WORDS and by_word > rules.MAX_WORD_DISTANCE
        assert r.kept == (not r.base_failed and not odd)


def test_js_distance():
    p, q = np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([[0.0, 1.0], [2.0, 2.0]])
    assert rules.js_distance(p, q).tolist() == [1.0, 0.0]


# -- 4 repeats --------------------------------------------------------------------------------


def test_anchors_of_a_long_text_are_found_by_windows(monkeypatch):
    rnd = random.Random(8)
    for _ in range(20):
        column = pa.array(["".join(rnd.choices("ab c", k=rnd.randrange(6000))) for _ in range(rnd.randrange(1, 6))])
        (block,) = texts.blocks(column, 1 << 30)
        monkeypatch.setattr(repeats, "WINDOW", 1 << 20)
        whole = repeats.anchors(block)
        monkeypatch.setattr(repeats, "WINDOW", 1000)
        assert all((a == b).all() for a, b in zip(whole, repeats.anchors(block)))


def test_anchors_are_rated_in_short_stretches(monkeypatch):
    """Every string's anchor, by the text it is in, however few starts are rated together."""
    rnd = random.Random(9)
    for starts in (1, 7, 400, repeats.STARTS):
        monkeypatch.setattr(repeats, "STARTS", starts)
        shared = "".join(rnd.choices("ab c", k=900))
        rows = [None, "", shared[:399], "x" * 401, shared, "", "y" + shared + "z", None]
        (block,) = texts.blocks(pa.array(rows), 1 << 30)
        text, place, stem = repeats.anchors(block)
        assert set(text.tolist()) == {3, 4, 6} and (np.diff(place) > 0).all()
        own = [(place[text == i] - block.starts[i]).tolist() for i in (4, 6)]
        # both copies have the same anchors at the same distance; the edges of the longer may have more
        assert {p + 1 for p in own[0]} <= set(own[1])
        for start in range(len(shared) - repeats.LENGTH + 1):
            assert any(start <= p <= start + repeats.REACH for p in own[0])


def without_repeats(rows):
    raw = [(t or "").encode() for t in rows]
    seen = {}
    for b in raw:
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("together", [2000, 3])
def test_repeats(spark, docs, empty, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rnd = random.Random(6)
    base = "".join(rnd.choices("abcdefgh é\n", k=1500))
    made = []
    for i in range(40):
        low = rnd.randrange(0, 600)
        x = base[low : low + rnd.randrange(380, 900)]
        at = rnd.randrange(len(x))
        made.append("".join(rnd.choices("ijkl", k=rnd.randrange(30))) + x[:at] + rnd.choice("XYZ") + x[at:] + "".join(rnd.choices("mno", k=rnd.randrange(30))))
    made += ["z" * 1000, "z" * 399, "ab" * 500, base[:400], base[:400], None, ""]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    for i, kept in enumerate(without_repeats(made)):
        assert bytes(got[i].kept) == kept, i
        assert got[i].n_bytes - sum(r.end - r.start for r in got[i].removed) == len(kept)
    if together == 3:
        return
    out = repeats.remove_repeats(docs)
    assert keys(out) == ALL_KEYS
    want = sorted(zip([i or -1 for i, _, _ in ROWS], without_repeats([t for _, t, _ in ROWS])))
    assert sorted((r.doc_id or -1, bytes(r.kept)) for r in out.collect()) == want
    assert repeats.remove_repeats(empty).count() == 0


# -- 5 bpe ------------------------------------------------------------------------------------


def test_bpe_gives_the_librarys_ids(docs, empty):
    library = Tokenizer.from_file(BPE)
    rnd = random.Random(7)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cases = ["", None, "<|endoftext|>a <|endoftext|><|endoftext|> b", "   x \n\n y\t z  ", "a" * 3000, " " * 999 + "x", LONG[:20000]]
    cases += ["".join(rnd.choices(every, k=30)) for _ in range(100)]
    cases += ["".join(rnd.choices("abcdeth in'sRe 019\n!?", k=60)) for _ in range(500)]
    for text, packed in zip(cases, bpe.encode_texts(BPE, cases)):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert bpe.decode_ids(bpe.vocabulary(BPE), packed) == library.decode(ids, skip_special_tokens=False)
    out = bpe.round_trip(docs, BPE, ["doc_id", "text"])
    assert keys(out) == ALL_KEYS and all(r.decoded == (r.text or "") for r in out.collect())
    ids = bpe.encode(docs, BPE, ["doc_id"])
    assert keys(bpe.decode(ids, BPE, ["doc_id"])) == ALL_KEYS
    assert bpe.round_trip(empty, BPE, ["doc_id"]).count() == 0


def test_bpe_splits_settled_characters_as_the_library_does():
    library = Tokenizer.from_file(BPE).pre_tokenizer
    for first in range(0, 0x20000, 4096):
        chars = [chr(c) for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}a1{c}1!{c}! {c} " for c in chars if not bpe.UNSETTLED.search(c))
        assert bpe.split_words(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


def test_bpe_merging_ways_agree():
    v, rnd = bpe.vocabulary(BPE), random.Random(8)
    words = ["".join(rnd.choices("etaoin shr", k=rnd.randrange(1, 40))).encode() for _ in range(500)]
    ids, owner = bpe.merge_together(v, words)
    for i, w in enumerate(words):
        assert ids[owner == i].tolist() == bpe.merge_exactly(v, w)
    ids, owner = bpe.proposals(v, words)
    for i, w in enumerate(words):
        assert ids[owner == i].tolist() == bpe.proposal(v, w)


# -- 6 toxicity -------------------------------------------------------------------------------


def test_toxicity_learns_from_training_rows_only(spark, docs, empty, labels):
    rows = [(i, sentence(i, 40) + (" vilestuff" if i % 2 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    wrong = known.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = toxicity.toxicity(df, known).collect()
    assert sorted(got) == sorted(toxicity.toxicity(df, wrong).collect())
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out]
    assert sum((r.score > 0.5) == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    out = toxicity.toxicity(docs, labels)
    assert keys(out) == ALL_KEYS and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(ROWS)


def test_training_takes_exactly_its_rows_and_keeps_the_odds(spark, monkeypatch):
    seen = []

    def fit(offset, bucket, weight, label):
        seen.append(np.bincount(label).tolist())
        return toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)

    monkeypatch.setattr(toxicity, "fit", fit)
    monkeypatch.setattr(toxicity, "TRAINING_ROWS", (200, 20))
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("text"))
    known = df.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    model = toxicity.train(df, known, F.lit(True), "doc_id", "text", "toxic")
    assert seen == [[200, 20]]
    assert np.isclose(model.bias, np.log(200 / 270) - np.log(20 / 30))


def test_bags_travel_packed():
    rows = ["", None, "x " * 300 + "yes no", " ".join(sentence(i, 60) for i in range(9))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([0] * 4), pa.array(rows)], names=["key", "_label", "text"])
    made = toxicity._bags(batch)
    order = np.array([3, 1, 0, 2])
    bags = toxicity.Bags(pa.table(made), order)
    plain = [pair for block in texts.blocks(pa.array(rows)) for pair in toxicity.counts(block)]
    assert max(n.max() for _, n in plain if len(n)) > 255 and max(b.max() for b, _ in plain if len(b)) > 1 << 16
    for i, row in enumerate(order):
        bucket, n = plain[row]
        assert bags.size[i] == len(bucket) and bags.bucket(i).tolist() == bucket.tolist()
        assert bags.share(i).tolist() == (n / max(n.sum(), 1)).astype(np.float32).tolist()
    # two numbers of four bytes each before
    assert len(made["low"][3].as_py()) + len(made["count"][3].as_py()) == 3 * len(plain[3][0])


# -- 7 near copies ----------------------------------------------------------------------------


def bags_of(rows):
    out = []
    for t in rows:
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        out.append({g: grams.count(g) for g in set(grams)})
    return out


def classes_of(rows, least=0.8):
    bags = bags_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(n, bags[j].get(g, 0)) for g, n in bags[i].items())
            if bags[i] and both >= least * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                root[find(i)] = find(j)
    members = {}
    for i, (k, _) in enumerate(rows):
        members.setdefault(find(i), []).append(k)
    return {k: min(m) for m in members.values() for k in m}


def test_near_copies(spark, docs, empty):
    rnd, rows = random.Random(9), []
    for g in range(12):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([6, 40, 120]))]
        for _ in range(rnd.choice([1, 4, 15])):
            x = list(words)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                x[rnd.randrange(len(x))] = f"w{rnd.randrange(500)}"
            rows.append((len(rows), " ".join(x * rnd.choice([1, 1, 1, 2]))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df).collect()}
    assert got == classes_of(rows)
    one = bagminhash.one_of_each(df.union(df))
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(got.values()))
    out = bagminhash.near_duplicates(docs)
    assert keys(out) == ALL_KEYS
    assert {(r.doc_id, r.class_id) for r in out.collect()} >= {(1, 1), (2, 1), (4, 4), (5, 5), (8, 8), (None, None)}
    assert bagminhash.near_duplicates(empty).count() == 0
    assert bagminhash.one_of_each(docs).columns == docs.columns


def test_every_pair_of_a_bucket_is_tested(spark, monkeypatch):
    """Forty pairs of near copies in one bucket, with no other bucket in common."""
    monkeypatch.setattr(bagminhash, "TILE", 30, raising=False)
    rows = [(2 * i + twin, " ".join(f"w{i}x{k}" for k in range(60)) + f" last{twin}") for i in range(40) for twin in (0, 1)]
    df = spark.createDataFrame(rows, "key long, text string").repartition(3)
    own = [F.xxhash64("node", F.lit(k)) for k in range(1, bagminhash.BANDS)]
    signed = texts.map_texts(df, ["key"], "text", bagminhash.SIGNED, bagminhash.sign)
    nodes = signed.withColumn("bands", F.array(F.lit(1).cast("long"), *own)).withColumn("n", F.col("n_shingles")).cache()
    roots = bagminhash.linked_roots(df, nodes, 0.8)
    got = {r.key: r.root for r in nodes.join(roots, "node").select("key", "root").collect()}
    assert len(got) == 80 and len(set(got.values())) == 40
    assert all(got[2 * i] == got[2 * i + 1] for i in range(40))


def test_signatures_estimate_weighted_similarity():
    rnd = random.Random(10)
    a = [" ".join(f"w{rnd.randrange(300)}" for _ in range(200)) for _ in range(60)]
    b = [x[: len(x) * 3 // 4] + " " + x[: len(x) // 4] for x in a]
    made = []
    for column in (a, b):
        for block in texts.blocks(pa.array(column), 1 << 24):
            text, hashes, weight, _ = bagminhash.shingles(block)
            edge = np.searchsorted(text, np.arange(len(column) + 1))
            bags = [hashes[s:e].tobytes() + weight[s:e].astype("<u4").tobytes() for s, e in zip(edge[:-1], edge[1:])]
            made.append((bags, bagminhash.signatures(text, hashes, weight, len(column))))
    true = np.array([bagminhash.weighted_jaccard(x, y) for x, y in zip(made[0][0], made[1][0])])
    assert abs(((made[0][1] == made[1][1]).mean(axis=1) - true).mean()) < 0.02


# -- 8 decontamination ------------------------------------------------------------------------


def test_contamination_of_tricky_rows(spark, docs, empty):
    items = [(1, sentence(50, 60)), (2, "one"), (3, None), (4, ""), (None, "alpha beta alpha beta"), (1, sentence(50, 60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs, bench, ["doc_id"])
    assert keys(out) == ALL_KEYS
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert got[9]["items"] == ["1"] and got[9].n_hit == 60
    assert got[11]["items"] == ["2"] and got[7]["items"] == [""] and got[7].n_hit == 4
    assert got[5].n_words == 0 and not got[5].contaminated
    assert decontaminate.contamination(empty, bench, ["doc_id"]).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0), ["doc_id"]).filter("contaminated").count() == 0


# -- 9 lines ----------------------------------------------------------------------------------


def test_lines_of_tricky_rows(docs, empty):
    out = units.dedup_units(docs)
    assert keys(out) == ALL_KEYS
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    text = dict((i, t) for i, t, _ in ROWS)
    assert got[9].removed == [] and got[9].kept_text == text[9]
    (span,) = got[10].removed
    assert text[10][span.start : span.end] == sentence(50, 60) and got[10].kept_text == sentence(11, 30)
    assert got[5].kept_text is None and got[8].kept_text == text[8] and got[2].kept_text == ""
    assert units.dedup_units(empty).count() == 0


def test_passages_of_short_lines_and_wrapped_paragraphs(spark):
    verse = ["one two", "three", "Four five six", "", "seven", "eight nine ten"]
    rows = [
        (1, "alpha\n" + "\n".join(verse) + "\nbeta"),
        (2, "own words\n" + "\n".join(verse)),
        (3, "x y\n\none  TWO three four\nfive six seven EIGHT\n\nend"),
        (4, "one two three four five six seven eight"),
        (5, "alpha\n\nthree\nbeta"),
        (None, "three"),
        (6, "a b\n" * 30 + "end"),
    ]
    got = {r.doc_id: r for r in units.dedup_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    # lines that recur one by one stay
    assert all(got[k].kept_text == t for k, t in rows if k in (None, 1, 3, 5))
    assert got[2].kept_text == "own words\n" and got[4].kept_text == ""
    # a line that is all of a text many times stays once, and with it what has too few words after it
    assert got[6].kept_text == "a b\nend"
    for key, text in rows:
        left = got[key].kept_text.split("\n")
        assert sum(s.end - s.start for s in got[key].removed) == sum(map(len, text.split("\n"))) - sum(map(len, left))


@pytest.mark.parametrize("least", [1, 4])
def test_units_against_plain_python(spark, least):
    rnd = random.Random(12)
    words = "a B c dd Dd".split()
    rows = []
    for i in range(200):
        lines = [" ".join(rnd.choices(words, k=rnd.choice([0, 0, 1, 2, 3]))) for _ in range(rnd.randint(0, 9))]
        rows.append((i, "\n".join(lines)))
    seen, want = set(), {}
    for key, text in rows:
        lines, drop, own = text.split("\n"), set(), set()
        found = [line.lower().split() for line in lines]
        said = lambda a, b: tuple(w for line in found[a : b + 1] for w in line)
        for a in range(len(lines)):
            ends = [b for b in range(a, len(lines)) if found[a] and found[b] and len(said(a, b)) >= least]
            own |= {(a, ends[0])} if ends else set()
            for b in range(a, len(lines)):
                bounded = (a == 0 or not found[a - 1]) and (b + 1 == len(lines) or not found[b + 1])
                if bounded and all(found[a : b + 1]) and len(said(a, b)) >= least:
                    own.add((a, b))
        for a, b in sorted(own):
            if said(a, b) in seen:
                drop |= set(range(a, b + 1))
            seen.add(said(a, b))
        want[key] = "\n".join(line for i, line in enumerate(lines) if i not in drop or not found[i])
    out = units.dedup_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words=least)
    assert {r.doc_id: r.kept_text for r in out.collect()} == want


# -- 10 chats ---------------------------------------------------------------------------------


def test_layouts_become_turns(spark):
    schema = (
        "id long, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
        "prompt string, response string, instruction string, input string, output string, odd string"
    )
    rows = [
        (1, [("user", "a"), ("assistant", None)], None, None, None, None, None, None, None),
        (2, None, [("human", "b"), ("gpt", "c")], None, None, None, None, None, None),
        (3, None, None, "p", "r", None, None, None, None),
        (4, None, None, None, None, "do", "this", "done", None),
        (5, None, None, None, None, "do", None, "done", None),
        (6, None, None, "p", "r", None, None, None, "what"),
        (7, [], None, None, None, None, None, None, None),
    ]
    got = {r.id: r for r in chatformat.canonical_turns(spark.createDataFrame(rows, schema), ["id"]).collect()}
    turns = {i: [tuple(t) for t in r.turns] if r.turns is not None else None for i, r in got.items()}
    assert turns == {
        1: [("user", "a"), ("assistant", None)], 2: [("user", "b"), ("assistant", "c")], 3: [("user", "p"), ("assistant", "r")],
        4: [("user", "do"), ("user", "this"), ("assistant", "done")], 5: [("user", "do"), ("assistant", "done")], 6: None, 7: [],
    }
    assert got[6].layout is None and got[4].layout == got[5].layout == "instruction" and got[4].fingerprint != got[5].fingerprint


def test_layouts_merged_into_one_column(spark):
    """Two layouts of messages in one struct, told apart by what each row fills."""
    schema = "id long, messages array<struct<role:string,content:string,text:string>>, conversations array<struct<from:string,value:string>>"
    rows = [
        (1, [("user", "a", None), ("assistant", "b", None)], None),
        (2, [("user", None, "c"), ("assistant", None, "d"), ("user", None, None)], None),
        (3, [("user", None, None)], None),
        (4, [("user", "e", None), ("assistant", None, "f")], None),
        (5, None, [("human", "g"), ("gpt", None)]),
        (6, [("user", "h", None)], [("human", "i")]),
        (7, [(None, None, None), None], None),
        (8, None, None),
    ]
    turned = chatformat.canonical_turns(spark.createDataFrame(rows, schema), ["id"])
    known, unknown = chatformat.split_layouts(turned)
    got = {r.id: [tuple(t) for t in r.t] for r in chatformat.formatted(known, ["id"]).select("id", chatformat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {
        1: [("user", "a"), ("assistant", "b")], 2: [("user", "c"), ("assistant", "d"), ("user", "")], 3: [("user", "")],
        5: [("user", "g"), ("assistant", "")], 7: [("", ""), ("", "")],
    }
    assert {r.id for r in unknown.collect()} == {4, 6, 8}
    assert all(r.formatted is None and r.loss_mask is None for r in chatformat.formatted(unknown, ["id"]).collect())


def test_running_totals(spark):
    rnd = random.Random(6)
    rows = [(n, [rnd.randrange(9) for _ in range(n)]) for n in (0, 1, 2, 3, 10, 17, 64, 100, 5000)]
    df = spark.createDataFrame(rows, "id long, sizes array<long>")
    for r in df.select("id", "sizes", chatformat.starts_of(F.col("sizes")).alias("at")).collect():
        assert r["at"] == [sum(r.sizes[:i]) for i in range(len(r.sizes))]


def test_template_is_read_back(spark):
    rnd = random.Random(11)
    bits = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "<\\|", "\n", "%", "%0A", "é", "assistant", "im_end|>", "a"]
    text = lambda: "".join(rnd.choices(bits, k=rnd.randrange(8)))
    chats = [(i, [(rnd.choice(["user", "assistant", text()]), rnd.choice([text(), None])) for _ in range(rnd.randrange(5))]) for i in range(300)]
    df = spark.createDataFrame([*chats, (300, None)], "id long, turns array<struct<role:string,text:string>>")
    out = chatformat.formatted(df, ["id"])
    read = out.select("id", chatformat.read_turns(F.col("formatted")).alias("t"), chatformat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    for r in read.collect():
        if r.id == 300:
            # null turns are no empty text
            assert r.t is None and r.loss is None
            continue
        turns = [(a or "", b or "") for a, b in chats[r.id][1]]
        assert [tuple(t) for t in r.t] == turns
        assert r.loss == "".join(b for a, b in turns if a == "assistant")


def test_rows_by_turn_are_gathered_in_order(spark):
    rows = [(1, 2, "assistant", "c"), (1, None, "system", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chatformat.gathered(df, "conv_id", "turn", "role", "text").collect()}
    assert got == {1: [("system", "a"), ("user", "b"), ("user", "b"), ("assistant", "c")], None: [(None, None)]}


# -- pipeline ---------------------------------------------------------------------------------


def test_stages_take_tricky_rows(spark, docs, empty, small):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == before.columns, name
        assert stage(spark, empty, small).count() == 0, name
    assert now.filter("not decodes_back").count() == 0


def test_pipeline_does_what_its_stages_say(spark, small):
    out = corpus_pipeline.run(spark, small)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    whole = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(whole, labels).collect() if r.predicted}
    rest = [(r.doc_id, r.text) for r in whole.orderBy("doc_id").collect() if r.doc_id not in toxic]
    first = set(classes_of(rest).values())
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.contamination(whole, bench, ["doc_id"]).filter("contaminated").collect()}
    # labels of the whole table train one model, whichever rows a stage keeps later
    assert ids == first - hit
    library = Tokenizer.from_file(BPE)
    for r in out.limit(20).collect():
        assert hashlib.sha256(r.ids).digest() and len(r.ids) == 4 * r.n_tokens
        assert np.frombuffer(r.ids, "<u4").max() < library.get_vocab_size()


def test_components_of_any_graph(spark, monkeypatch):
    rnd = random.Random(7)
    stars = [(i, i % 10) for i in range(10, 500)]
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    loose = [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(180)]
    edges = stars + stars + chain + loose + [(5000, 5000)]
    rnd.shuffle(edges)
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in edges:
        if u != v:
            parent[max(find(u), find(v))] = min(find(u), find(v))
    made = components.components(spark.createDataFrame(edges, "u long, v long"))
    rows = made.collect()
    assert len(rows) == len(parent)
    assert {r.node: r.root for r in rows} == {i: find(i) for i in parent}
    # what is a star already is told without a round
    labels = []
    real = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: labels.append(label) or real(df, label))
    components.components(spark.createDataFrame(stars, "u long, v long"))
    assert labels == ["edges", "around"]


def test_links_join_known_components(spark):
    roots = components.components(spark.createDataFrame([(1, 2), (3, 4), (5, 6), (8, 9)], "u long, v long"))
    more = spark.createDataFrame([(4, 6), (9, 7)], "u long, v long")
    got = {r.node: r.root for r in bagminhash.joined_roots(roots, more).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7, 8: 7, 9: 7}
    assert bagminhash.joined_roots(roots, more.limit(0)) is roots


def test_pipeline_sends_no_text_back(spark):
    rows = [(1, "de", "a", "some words, ä and 文字"), (2, None, None, None), (3, "fr", "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    made = corpus_pipeline.encode(spark, docs, "")
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = bpe.round_trip(docs, path, ["doc_id", "text"]).collect()
    ids = {r.doc_id: bytes(r.ids) for r in whole}
    assert [(r.doc_id, r.lang, r.source) for r in made.orderBy("doc_id").collect()] == [r[:3] for r in rows]
    assert {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in made.collect()} == {i: (len(x) // 4, x) for i, x in ids.items()}
    assert {r.doc_id: r.decodes_back for r in made.collect()} == {r.doc_id: r.decoded == (r.text or "") for r in whole}
    python = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    # neither texts nor what is decoded leave Python
    assert len(python) == 1
    out = python[0].rpartition("[")[2]
    assert (out.count("_k"), out.count("_r"), out.count(",")) == (3, 2, 5)
