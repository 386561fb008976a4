"""Secret scans: known forms, and strings too random to be anything else.

Known forms are found by three patterns. Other long runs of letters and digits go through a
battery of tests in the encoding they seem to be in: chi-squared uniformity over the alphabet,
a runs test and a lag-1 serial correlation. A run is reported if no test speaks against
randomness and its uniformity cannot be that of written text, with the false discovery rate
held over all runs of the table by classes of length and encoding. Native expressions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packfold.plans.barrier import computed_once
from packfold.session import materialize

# Kinds of known forms in the order of the report, with their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH = 12
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

# (name, pattern, alphabet, deviation of written text from uniformity per character)
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.6),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.2),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.2),
    ("base64", ".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.0),
)
LENGTHS = (28, 40, 64)
# Level at which a test speaks against randomness, after correction for three tests.
REJECTED = 0.001
# Share of false reports among a class's reports.
FALSE_DISCOVERIES = 0.01
# p-values are counted in tenths of a power of ten, rounded up.
BINS = 400

SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, found: Column, pattern: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans (start, rank, end) in code points of a pattern's matches, those to keep.

    Text between matches and matches take turns, so lengths add up to places."""

    def step(seen: Column, pair: Column) -> Column:
        start = seen["at"] + F.length(pair["piece"])
        end = start + F.coalesce(F.length(pair["match"]), F.lit(0))
        span = F.array(F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end")))
        wanted = pair["match"].isNotNull() & (keep(pair["match"]) if keep else F.lit(True))
        return F.struct(end.cast("long").alias("at"), F.when(wanted, F.concat(seen["spans"], span)).otherwise(seen["spans"]).cast(SPAN).alias("spans"))

    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    spans = F.aggregate(pairs, begin, step, lambda s: s["spans"])
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution; relative error below 2e-7 at any size.

    Fixed values: coefficients of a published Chebyshev fit of the complementary error function."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + F.lit(c)
    half = 0.5 * t * F.exp(fit - x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def _choose(encoding: Column, values: Sequence) -> Column:
    out = F.lit(values[-1])
    for i in range(len(values) - 1):
        out = F.when(encoding == i, F.lit(values[i])).otherwise(out)
    return out


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def battery() -> list[Callable[[Column], Column]]:
    """Steps of the tests, each to be applied to every candidate (start, end, token)."""

    def coded(c: Column) -> Column:
        body = F.regexp_replace(c["token"], "=+$", "")
        encoding = F.lit(len(ENCODINGS) - 1)
        for i in reversed(range(len(ENCODINGS) - 1)):
            encoding = F.when(body.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(encoding)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), body.alias("body"), encoding.alias("encoding"))

    def numbers(c: Column) -> Column:
        alphabet = _choose(c["encoding"], [e[2] for e in ENCODINGS])
        plain = F.when(c["encoding"] == 0, F.lower(c["body"])).otherwise(F.translate(c["body"], "-_", "+/"))
        codes = F.transform(F.filter(F.split(plain, ""), lambda x: x != ""), lambda x: F.instr(alphabet, x) - 1)
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), codes.alias("codes"),
            F.size(codes).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
        )

    def sums(c: Column) -> Column:
        codes, n, k = c["codes"], c["n"], c["k"]
        counts = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda v: F.size(F.filter(codes, lambda x: x == v)).cast("double"))
        squares = _total(F.transform(counts, lambda x: x * x))
        high = _total(F.transform(codes, lambda x: (x * 2 >= k).cast("double")))
        first, second = F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1)
        turns = _total(F.zip_with(first, second, lambda a, b: ((a * 2 >= k) != (b * 2 >= k)).cast("double")))
        mean = _total(F.transform(codes, lambda x: x.cast("double"))) / n
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), n.alias("n"), k.alias("k"),
            (k / n * squares - n).alias("chi"), high.alias("high"), (turns + 1).alias("runs"),
            _total(F.transform(codes, lambda x: (x - mean) * (x - mean))).alias("variance"),
            _total(F.zip_with(first, second, lambda a, b: (a - mean) * (b - mean))).alias("serial"),
        )

    def values(c: Column) -> Column:
        n, free = c["n"], c["k"] - 1
        cube = (F.cbrt(c["chi"] / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        expected = 2 * c["high"] * (n - c["high"]) / n
        spread = expected * (expected - 1) / (n - 1)
        runs = F.when(spread > 0, F.abs(c["runs"] - expected - 1) / F.sqrt(spread)).otherwise(F.lit(40.0))
        serial = F.when(c["variance"] > 0, F.abs(c["serial"] / c["variance"]) * F.sqrt(n)).otherwise(F.lit(40.0))
        odd = 3 * F.least(_tail(cube), 2 * _tail(runs), 2 * _tail(serial))
        drift = _choose(c["encoding"], [e[3] for e in ENCODINGS]) * n
        written = _tail((free + drift - c["chi"]) / F.sqrt(2 * (free + 2 * drift)))
        bin_ = F.least(F.floor(-10 * F.log10(F.greatest(written, F.lit(1e-60)))), F.lit(BINS)).cast("int")
        long = F.lit(0)
        for i, limit in enumerate(LENGTHS):
            long = F.when(n >= limit, F.lit(i + 1)).otherwise(long)
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), (c["encoding"] * 10 + long).alias("stratum"),
            F.when(odd < REJECTED, F.lit(-1)).otherwise(bin_).alias("bin"),
        )

    return [coded, numbers, sums, values]


def scanned(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns, base (spans of known forms) and tested (start, end, stratum, bin of the
    other random-looking runs; bin -1 if a test spoke against randomness)."""
    inner = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")
    )
    whole = F.col("_text")
    patterns = (ASSIGN, ACCESS, HEX, RANDOM)
    found = computed_once(rows, **{f"_m{i}": matches(whole, p) for i, p in enumerate(patterns)})
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LENGTH
    spans = [placed(whole, F.col(f"_m{i}"), p, i, long_enough if i == 0 else None) for i, p in enumerate(patterns)]
    known = computed_once(found, _base=F.array_sort(F.concat(*spans[:3])), _runs=spans[3])
    free = F.filter("_runs", lambda r: ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    tokens = F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.substring(whole, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")).alias("token")))
    out = computed_once(known.select(*inner, "_base", whole, "_runs"), _tested=tokens)
    for step in battery():
        out = computed_once(out.select(*inner, "_base", F.col("_tested").alias("_c")), _tested=F.transform("_c", step))
    return out.select(*[F.col(k).alias(c) for k, c in zip(inner, keep)], F.col("_base").alias("base"), F.col("_tested").alias("tested"))


def thresholds(scan: DataFrame) -> dict[int, int]:
    """Least bin to report for each class of encoding and length, by Benjamini and Hochberg.

    All runs of the table count as tests. At most (encodings x lengths x BINS) rows reach the
    driver. A p-value counts as the upper end of its bin, so the rate is never exceeded."""
    runs = scan.select(F.inline("tested")).groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    by: dict[int, dict[int, int]] = {}
    for r in runs.collect():
        by.setdefault(r.stratum, {})[r.bin] = r.n
    out = {}
    for stratum, counts in by.items():
        total, above = sum(counts.values()), 0
        for b in range(BINS, -1, -1):
            above += counts.get(b, 0)
            if above and 10 ** (-b / 10) <= FALSE_DISCOVERIES * above / total:
                out[stratum] = b
    return out


def secrets(df: DataFrame, keep: Sequence[str], text: str = "text", output: str = "spans") -> DataFrame:
    """``keep`` columns and, as ``output``, spans (start, end, kind), sorted by start, then by
    kind as in KINDS.

    Spans are in code points, ends exclusive. Known forms are always reported; a random run
    only where it overlaps none. Null texts are empty. Rows stay rows, repeated ones too, and
    an empty table gives an empty one. ``keep`` may hold columns of any name; others go.
    """
    inner = [f"_c{i}" for i in range(len(keep))]
    named = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)], F.col(f"`{text}`").alias("_whole"))
    scan = materialize(scanned(named, inner, "_whole"), "secret-scan")
    least = thresholds(scan)
    flagged = F.array().cast(SPAN)
    if least:
        table = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
        chosen = F.filter("tested", lambda c: F.coalesce(c["bin"] >= F.element_at(table, c["stratum"]), F.lit(False)))
        flagged = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"))).cast(SPAN)
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(
        F.array_sort(F.concat("base", flagged)),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["rank"] + 1).alias("kind")),
    )
    return scan.select(*[F.col(k).alias(c) for k, c in zip(inner, keep)], spans.alias(output))


def told(spans: Column, kinds: Sequence[str] = KINDS) -> Column:
    """kind:start:end of spans of these kinds, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping ones, replaced by ``mark``."""

    def cut(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    def step(seen: Column, span: Column) -> Column:
        apart = span["start"] >= seen["at"]
        out = F.when(apart, F.concat(seen["out"], cut(seen["at"], span["start"]), F.lit(mark))).otherwise(seen["out"])
        return F.struct(F.greatest(seen["at"], span["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    joined = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], cut(s["at"], F.length(text).cast("long"))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
