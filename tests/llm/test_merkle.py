"""The manifest against plain Python, on nulls, shared ids, ids far apart and groups of many sizes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from packfold.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _leaf string, root string, _word long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(digests):
    """All levels, and each node's siblings on the way up as (left, right)."""
    levels, paths, at = [digests], [[] for _ in digests], list(range(len(digests)))
    while len(levels[-1]) > 1:
        now = levels[-1]
        for i, place in enumerate(at):
            run = place // 8 * 8
            paths[i].append(("".join(now[run:place]), "".join(now[place + 1 : run + 8])))
            at[i] = place // 8
        levels.append([sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels[-1][0], paths


def expected(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        def digest(text):
            values = [doc_id, source, lang, n_chars, text]
            return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        groups.setdefault(lang, []).append((doc_id, digest(text), digest(low) if hit else digest(text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    tops = {g: tree([r[1] for r in groups[g]]) for g in names}
    root, above = tree([tops[g][0] for g in names])
    out = []
    for g, over in zip(names, above):
        for (doc_id, leaf, claim), path in zip(groups[g], tops[g][1]):
            fold = claim
            for left, right in path + over:
                fold = sha(left + fold + right)
            proof = sha("".join(a + b for a, b in path + over))
            out.append((doc_id, leaf, tops[g][0], root, proof, fold, fold == root))
    return sorted(out, key=str)


def made(sizes, seed=1):
    rnd = random.Random(seed)
    rows, next_id = [], 0
    for lang, n, spread in sizes:
        for _ in range(n):
            next_id += 1
            doc_id = next_id if spread == 1 else rnd.randint(-(2**63), 2**63 - 1) if spread == 2 else rnd.randint(0, n // 2)
            text = rnd.choice(["", None, "Same TEXT", f"Ärger {next_id} UND so"])
            rows.append((doc_id if rnd.random() < 0.98 else None, text, lang, rnd.choice(["s", None]), rnd.choice([None, 3]), "x", "y", 1))
    rows += rows[:40]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        [("en", 1, 1)],
        [("en", 700, 1), (None, 9, 2), ("", 1, 1), ("é", 8, 1), ("z", 65, 2), ("-", 2, 3), ("=", 300, 3)],
        [(f"l{i}", 1 + i % 3, 1) for i in range(70)],
    ],
)
def test_query_equals_plain_python(spark, tmp_path, sizes):
    rows = made(sizes)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)
    assert got == expected(rows)
    # lower case changes some rows, and those are told
    assert len(rows) < 50 or {r[-1] for r in got} == {True, False}


def test_many_equal_rows_and_paths(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 16)
    rows = [(7, "Same", "en", "s", 4, "", "", 0)] * 900 + [(i, "Own", "en", "s", 4, "", "", 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    leaf = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    out = merkle.manifest(df, "doc_id", "lang", leaf, paths=True)
    found = [tuple(r) for r in out.drop("path").collect()]
    assert sorted(r[:5] for r in found) == sorted(r[:5] for r in expected(rows))
    assert all(r[6] for r in found)
    again = out.select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("fold"), F.size("path").alias("n"))
    assert again.filter("fold <> root").count() == 0 and {r.n for r in again.collect()} == {4}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty, "doc_id", "lang", merkle.leaf(F.col("text"))).count() == 0
