"""Resampling and toxicity scores against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from packfold.llm import resampling, texts, toxicity

VOCABULARY = "Alpha beta gamma délta EPS zeta 7 eta théta iota kappa lambda mu".split()


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", low)


def sentence(rnd, n, of):
    return "".join(rnd.choice(of) + rnd.choice([" ", " ", ", ", "\n", "-"]) for _ in range(n))


@pytest.mark.parametrize("share", [0.2, 0.75])
def test_resampling_equals_plain_python(spark, share):
    rnd = random.Random(3)
    rows = [(i, sentence(rnd, rnd.randrange(30), VOCABULARY[:8] if i % 3 else VOCABULARY[5:]), i % 3 == 1) for i in range(150)]
    rows += [(200, None, True), (201, " ... ", False), (None, "alpha beta", None), (5, rows[5][1], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(4)
    got = {(r.doc_id, r.n_ngrams): r for r in resampling.resample(df, "good", share).collect()}

    grams = [[*w, *zip(w, w[1:])] for w in (words(t) for _, t, _ in rows)]
    raw = Counter(g for own in grams for g in own)
    target = Counter(g for own, row in zip(grams, rows) for g in own if row[2])
    scale = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + 2) / (raw[g] * scale + 2)) for g in raw}
    keys = []
    for (key, _, _), own in zip(rows, grams):
        draw = int(hashlib.md5(f"42:{'null' if key is None else key}".encode()).hexdigest()[:8], 16) / 2**32 + 0.5 / 2**32
        total = sum(ratio[g] for g in own)
        r = got[key, len(own)]
        if own:
            assert math.isclose(r.log_weight, total, abs_tol=1e-9)
            assert math.isclose(r.gumbel_key, total - math.log(-math.log(draw)), abs_tol=1e-9)
            keys.append((r.gumbel_key, r))
        else:
            assert r.log_weight is None and r.gumbel_key is None and not r.kept
    least = sorted((k for k, _ in keys), reverse=True)[math.ceil(share * len(keys)) - 1]
    assert all(r.kept == (k >= least) for k, r in keys)


def hashed(data, lower):
    block = np.frombuffer(data, np.uint8)
    sums = texts.prefix_hash(block, texts.LOWER) if lower else texts.prefix_hash(block)
    return texts.slice_hash(sums, np.array([0]), np.array([len(data)]))


def test_toxicity_scores_equal_plain_python(spark):
    rnd = random.Random(9)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 3, toxicity.BUCKETS), -0.4)
    rows = [(i, sentence(rnd, rnd.randrange(12), VOCABULARY)) for i in range(80)] + [(90, None), (91, ""), (92, "?!"), (93, "é " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    for key, text in rows:
        buckets = []
        for word in words(text):
            buckets.append(int(texts.mix(hashed(word.encode(), True))[0]) % toxicity.BUCKETS)
            marked = f"<{word}>"
            for n in toxicity.SIZES:
                buckets += [int(hashed(marked[i : i + n].encode(), False)[0]) % toxicity.BUCKETS for i in range(len(marked) - n + 1)]
        mean = sum(model.rows[b] for b in buckets) / max(len(buckets), 1)
        score = 1 / (1 + math.exp(-(model.bias + mean)))
        assert math.isclose(got[key].score, score, rel_tol=1e-9), text
        assert got[key].predicted == (got[key].score >= toxicity.THRESHOLD)
