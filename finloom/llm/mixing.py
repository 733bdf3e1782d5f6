"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id and text. A source's target is met by taking every document
floor(target / size) times and those below a hash threshold once more. The threshold is found without sorting: one pass
sums tokens by (source, first 20 hash bits); two looks at this histogram, ten bits each, say in which bucket the budget
runs out; only that bucket's documents are written apart and summed again by the next ten bits, until the bits end.
Thresholds of smaller budgets lie below those of larger ones, so mixes are nested. One row a source reaches the driver
(sizes, then boundary buckets); histograms stay distributed. Sizes are counted once and stored with the documents'
hashes; a result without the text is read from there.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null id counts in the
hash as such; documents of size 0 are taken 0 words; equal rows share a hash and are taken alike; very long texts count
whole, and may overshoot a target by at most half of their size; an empty table gives an empty table; a source whose
size is 0 has target 0. Further columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import WORD, materialise

#: The weights that sources get in turn, and the most often a source may be repeated.
WEIGHTS, REPEATS = (5, 2, 1), 3
BITS, LEVELS = 10, 6
#: Up to so many sources the table of thresholds is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: dict, weights=WEIGHTS, repeats: float = REPEATS, budget: float = 1.0) -> dict:
    """Target words by source: shares by weight of the budget, none above repeats x its size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out = set(order), float(sum(sizes.values())) * budget, {}
    while left:
        share = total / sum(weight[s] for s in left)
        full = [s for s in order if s in left and share * weight[s] > repeats * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in left}
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
            total -= out[s]
            left.discard(s)
    return out


def _bits(level: int, n: int = 1):
    """The n x ten hash bits from the level on, the highest first."""
    return F.shiftright("__m_h", BITS * (LEVELS - n - level)).bitwiseAND((1 << BITS * n) - 1)


def _prefix(level: int):
    """All hash bits above those of the level."""
    return F.shiftright("__m_h", BITS * (LEVELS - level))


def _by_source(spark, rows, fields, wide: bool):
    df = spark.createDataFrame(rows, T.StructType([T.StructField("__m_s", T.StringType()), *fields]))
    return df if wide else F.broadcast(df)


def histogram(sized: DataFrame) -> DataFrame:
    """(source, __m_h, size): token sums by the first twenty hash bits, each at its bucket's first hash."""
    first = F.shiftleft(_prefix(2), BITS * (LEVELS - 2))
    return sized.groupBy("source", first.alias("__m_h")).agg(F.sum("size").alias("size"))


def thresholds(sized: DataFrame, hist: DataFrame, need: dict) -> dict:
    """Hash threshold by source so that the documents below it hold about need[source] words."""
    spark = sized.sparkSession
    wide = len(need) > BROADCAST_SOURCES
    state = {s: (0, 0, float(n)) for s, n in need.items()}  # prefix found so far, words below it, words wanted
    open_ = set(need)
    rows_ = hist
    for level in range(LEVELS):
        if not open_:
            break
        rows = [(s, state[s][0], state[s][1], state[s][2]) for s in open_]
        at = _by_source(spark, rows, [T.StructField("__m_p", T.LongType()), T.StructField("__m_below", T.LongType()), T.StructField("__m_want", T.DoubleType())], wide)
        within = lambda df: df.join(at, F.col("source").eqNullSafe(F.col("__m_s")) & (_prefix(level) == F.col("__m_p")))  # noqa: B023, E731
        if level == 2:  # the histogram ends: the boundary buckets' documents, about a millionth of all
            rows_ = materialise(within(sized).select("source", "size", "__m_h"), "boundary")
        sums = within(rows_).groupBy("__m_s", _bits(level).alias("b")).agg(F.sum("size").alias("n"), F.first("__m_below").alias("below"), F.first("__m_want").alias("want"))
        up = F.sum("n").over(W.partitionBy("__m_s").orderBy("b").rowsBetween(W.unboundedPreceding, 0)) + F.col("below")
        edge = sums.withColumn("up", up).filter(F.col("up") >= F.col("want")).groupBy("__m_s").agg(F.min(F.struct("b", "up", "n")).alias("e")).select("__m_s", "e.b", "e.up", "e.n").collect()
        found = {r["__m_s"]: r for r in edge}
        for s in list(open_):
            r = found.get(s)
            prefix, below, want = state[s]
            if r is None:  # no documents are left above: everything below the end of this prefix
                state[s] = ((prefix + 1) << BITS * (LEVELS - level), below, want)
                open_.discard(s)
            elif level == LEVELS - 1:
                last = (prefix << BITS) + r["b"]
                over, under = r["up"] - want, want - (r["up"] - r["n"])
                state[s] = (last + (over <= under), 0, want)
                open_.discard(s)
            elif r["up"] == want:  # the bucket's end meets the budget
                state[s] = (((prefix << BITS) + r["b"] + 1) << BITS * (LEVELS - 1 - level), 0, want)
                open_.discard(s)
            else:
                state[s] = ((prefix << BITS) + r["b"], r["up"] - r["n"], want)
    return {s: state[s][0] for s in need}


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, budgets=(1.0,), text: str = "text", columns=None) -> DataFrame:
    """docs with size, source_size, target and taken; with further budgets also target_i and taken_i for each of them.

    budgets are shares of all words, the first one gives target and taken. columns: those of docs that the result
    carries (all of them by default); without the text, texts are read once only.
    """
    results = {"size", "source_size", "target", "taken", *(f"{n}_{i}" for i in range(1, len(budgets)) for n in ("target", "taken"))}
    passing = [c for c in (docs.columns if columns is None else columns) if c not in results]
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    # ids and texts decide the place in the mix, whatever the order of rows and partitions: 60 bits of a digest
    part = lambda c: F.coalesce(F.concat(F.col(c).cast("string"), F.lit("|")), F.lit(""))
    place = F.conv(F.substring(F.md5(F.concat(part("doc_id"), part(text))), 1, 15), 16, 10).cast("long")
    carried = [] if text in passing else passing
    sized = materialise(docs.select(*[F.col(f"`{c}`").alias(f"__m_c_{i}") for i, c in enumerate(carried)], F.col("source").cast("string").alias("source"), size.alias("size"), place.alias("__m_h")), "mix")
    hist = materialise(histogram(sized), "histogram")
    totals = {r["source"]: int(r["n"]) for r in hist.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    rows = {s: [s, n] for s, n in totals.items()}
    fields = [T.StructField("source_size", T.LongType())]
    out_columns = []
    for i, budget in enumerate(budgets):
        goal = targets(totals, weights, repeats, budget)
        whole = {s: min(repeats, int(goal[s] // totals[s])) if totals[s] else 0 for s in totals}
        rest = {s: goal[s] - whole[s] * totals[s] for s in totals if whole[s] < repeats and totals[s]}
        cut = thresholds(sized, hist, {s: r for s, r in rest.items() if r > 0})
        tail = f"_{i}" if i else ""
        for s in totals:
            rows[s] += [goal[s], whole[s], cut.get(s, 0)]
        fields += [T.StructField(f"target{tail}", T.DoubleType()), T.StructField(f"__m_whole{tail}", T.LongType()), T.StructField(f"__m_cut{tail}", T.LongType())]
        once = (F.col("__m_h") < F.col(f"__m_cut{tail}")).cast("long")
        out_columns += [F.col(f"target{tail}"), (F.col("size") * (F.col(f"__m_whole{tail}") + once)).alias(f"taken{tail}")]
    by_source = _by_source(spark, [tuple(r) for r in rows.values()], fields, len(rows) > BROADCAST_SOURCES)
    if carried:
        marked = sized.select(*[F.col(f"__m_c_{i}").alias(c) for i, c in enumerate(carried)], F.col("source").alias("__m_source"), "size", "__m_h")
    else:
        marked = docs.drop(*[c for c in docs.columns if c in results]).withColumns({"size": size, "__m_h": place, "__m_source": F.col("source").cast("string")})
    return marked.join(by_source, F.col("__m_source").eqNullSafe(F.col("__m_s")), "left").select(*[F.col(f"`{c}`") for c in passing], "size", "source_size", *out_columns)
