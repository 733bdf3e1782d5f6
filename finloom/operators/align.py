"""Aligning the rows of a table from two sources, and merging or voting on what they say."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import similarity, text
from ..functions.columns import flag_of, rank_flag
from ..storage import stored
from .match import blocked_pairs, dimension


def align_rows(a: DataFrame, b: DataFrame, keys, config: Config = DEFAULT) -> DataFrame:
    """Rows of a and b (row_idx, label, canonical, section) matched in four phases: (keys, a_idx, b_idx, method, score).

    1 equal canonical terms, first rows first; 2 similar texts, best pairs first, one to one; 3 position within the
    section among what is left (no section is a section); 4 orphans of either side.
    """
    keys = list(keys)
    left = a.select(*keys, F.col("row_idx").alias("a_idx"), F.col("label").alias("a_label"), F.col("canonical").alias("a_term"), F.col("section").alias("a_section"))
    right = b.select(*keys, F.col("row_idx").alias("b_idx"), F.col("label").alias("b_label"), F.col("canonical").alias("b_term"), F.col("section").alias("b_section"))

    def first(df: DataFrame, term: str, idx: str) -> DataFrame:
        w = W.partitionBy(*keys, term).orderBy(idx)
        return df.filter(F.col(term).isNotNull()).withColumn("r", F.row_number().over(w)).filter("r = 1").select(*keys, F.col(term).alias("term"), idx)

    one = first(left, "a_term", "a_idx").join(first(right, "b_term", "b_idx"), [*keys, "term"]).select(*keys, "a_idx", "b_idx", F.lit("canonical").alias("method"), F.lit(1.0).alias("score"))
    rest_a, rest_b = left.join(one, [*keys, "a_idx"], "left_anti"), right.join(one, [*keys, "b_idx"], "left_anti")
    # candidates share two neighbouring characters, ends included: complete for ratios from 0.67 up; each pair of texts
    # of a table is scored once
    form = lambda df, side: df.withColumns({"scope": F.struct(*keys), "form": text.normalize(F.col(f"{side}_label"))})
    form_a, form_b = form(rest_a, "a"), form(rest_b, "b")
    scored = blocked_pairs(form_a, form_b, "form", "\u0001").withColumn("score", similarity.indel_ratio(F.col("l"), F.col("r")) / 100).filter(F.col("score") >= config.align_cut)
    pairs = scored.join(form_a.withColumnRenamed("form", "l").select("scope", "l", *keys, "a_idx"), ["scope", "l"]).join(form_b.withColumnRenamed("form", "r").select("scope", "r", "b_idx"), ["scope", "r"])
    two = greedy_pairs(pairs.select(*keys, "a_idx", "b_idx", "score"), keys)
    two = stored(two.select(*keys, "a_idx", "b_idx", F.lit("text").alias("method"), "score"), "pairs")
    rest_a, rest_b = rest_a.join(two, [*keys, "a_idx"], "left_anti"), rest_b.join(two, [*keys, "b_idx"], "left_anti")

    def numbered(df: DataFrame, side: str) -> DataFrame:
        w = W.partitionBy(*keys, f"{side}_section").orderBy(f"{side}_idx")
        return df.select(*keys, f"{side}_idx", F.col(f"{side}_section").alias("s"), F.row_number().over(w).alias("n")).withColumn("s", F.struct(F.col("s").isNull().alias("none"), F.coalesce("s", F.lit("")).alias("v")))

    three = numbered(rest_a, "a").join(numbered(rest_b, "b"), [*keys, "s", "n"]).select(*keys, "a_idx", "b_idx", F.lit("position").alias("method"), F.lit(0.5).alias("score"))
    only_a = rest_a.join(three, [*keys, "a_idx"], "left_anti").select(*keys, "a_idx", F.lit(None).cast("int").alias("b_idx"), F.lit("a_orphan").alias("method"), F.lit(0.0).alias("score"))
    only_b = rest_b.join(three, [*keys, "b_idx"], "left_anti").select(*keys, F.lit(None).cast("int").alias("a_idx"), "b_idx", F.lit("b_orphan").alias("method"), F.lit(0.0).alias("score"))
    return reduce(DataFrame.unionByName, [one, two, three, only_a, only_b])


def greedy_pairs(pairs: DataFrame, keys) -> DataFrame:
    """Best scores first, each row once, ties by (a, b): sequential by nature, so one table pair at a time in pandas."""
    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "a_idx", "b_idx"], ascending=[False, True, True], kind="stable")
        a, b, keep = set(), set(), []
        for i, (x, y) in enumerate(zip(group["a_idx"], group["b_idx"])):
            if x not in a and y not in b:
                a.add(x)
                b.add(y)
                keep.append(i)
        return group.iloc[keep]

    return pairs.groupBy(*keys).applyInPandas(pick, pairs.schema)


def coverage(alignment: DataFrame, keys) -> DataFrame:
    """Share of a's rows that found a partner."""
    return alignment.filter(F.col("a_idx").isNotNull()).groupBy(*keys).agg(F.avg(F.col("b_idx").isNotNull().cast("int")).alias("coverage"))


def merge_cells(a: Column, b: Column, a_num: Column, b_num: Column, tolerance: float = 1.0) -> dict[str, Column]:
    """Fields of a cell merged from two sources: raw, value, provenance, flag, confidence, conflict."""
    both = a_num.isNotNull() & b_num.isNotNull()
    agree = both & (F.abs(a_num - b_num) <= tolerance)
    texts = a_num.isNull() & b_num.isNull() & a.isNotNull() & b.isNotNull()
    same = texts & (F.trim(a) == F.trim(b))
    state = F.when(agree | same, "consensus").when(both, "tier0").when(a_num.isNotNull(), "tier0").when(b_num.isNotNull(), "tier1").when(a.isNotNull(), "tier0").otherwise("tier1")
    return {
        "value": F.coalesce(a_num, b_num),
        "raw_value": F.when(a_num.isNotNull() | (b_num.isNull() & a.isNotNull()), a).otherwise(b),
        "provenance": state,
        "flag": F.when(agree | same, "green").when(both | texts, "yellow").when(a.isNull(), "yellow").otherwise("green"),
        "confidence": F.when(agree, 1.0).when(both, 0.85).when(same, 1.0).when(texts, 0.80).otherwise(0.90),
        "conflict": (both & ~agree) | (texts & ~same),
    }


def reconcile(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Cells (keys, raw_value, value) of two sources merged by full outer join."""
    x, y = a.select(*keys, F.col("raw_value").alias("a"), F.col("value").alias("an")), b.select(*keys, F.col("raw_value").alias("b"), F.col("value").alias("bn"))
    fields = merge_cells(F.col("a"), F.col("b"), F.col("an"), F.col("bn"))
    return x.join(y, list(keys), "full_outer").select(*keys, *[v.alias(k) for k, v in fields.items()])


def supplement(primary: DataFrame, other: DataFrame, keys=("doc_id",)) -> DataFrame:
    """primary's tables and those of other whose position primary does not reach."""
    n = primary.groupBy(*keys).agg((F.max("table_idx") + 1).alias("n"))
    extra = other.join(n, list(keys), "left").filter(F.col("table_idx") >= F.coalesce("n", F.lit(0))).drop("n")
    return primary.unionByName(extra)


def medoid(strings: Column) -> Column:
    """struct(delta, at): mean normalized edit distance to the others of the most central string, and its place."""
    n = F.size(strings)
    means = F.transform(
        strings,
        lambda x, i: F.struct(F.when(n < 2, 0.0).otherwise(F.aggregate(F.transform(strings, lambda y: similarity.normalized_levenshtein(x, y)), F.lit(0.0), lambda s, v: s + v) / (n - 1)).alias("delta"), i.alias("at")),
    )
    return F.array_min(means)


def vote_numeric(votes: Column, tolerance: float = 1.0) -> Column:
    """Clusters of array<struct<weight, value, source>>: heaviest first, joined to the first cluster whose anchor is near.

    A fold over at most as many elements as there are sources; the result is array<struct<anchor, weight, n>>.
    """
    ordered = F.array_sort(votes, lambda x, y: F.when(x["weight"] > y["weight"], -1).when(x["weight"] < y["weight"], 1).otherwise(F.when(x["source"] < y["source"], -1).otherwise(1)))
    empty = F.expr("cast(array() as array<struct<anchor:double,weight:double,n:int>>)")

    def place(clusters: Column, v: Column) -> Column:
        at = F.array_position(F.transform(clusters, lambda c: F.abs(c["anchor"] - v["value"]) <= tolerance), True)
        fresh = F.struct(v["value"].cast("double").alias("anchor"), v["weight"].cast("double").alias("weight"), F.lit(1).alias("n"))
        grown = F.transform(clusters, lambda c, i: F.struct(c["anchor"].alias("anchor"), (c["weight"] + F.when(i + 1 == at, v["weight"]).otherwise(0.0)).cast("double").alias("weight"), (c["n"] + F.when(i + 1 == at, 1).otherwise(0)).cast("int").alias("n")))
        return F.when(at > 0, grown).otherwise(F.concat(clusters, F.array(fresh)))

    return F.aggregate(ordered, empty, place)


def vote_flag(delta: Column, contributors: Column, config: Config = DEFAULT) -> Column:
    return F.when(delta >= config.delta_red, "red").when((delta <= config.delta_green) & (contributors >= 2), "green").otherwise("yellow")


def vote_cells(cells: DataFrame, keys, tolerance: float = 1.0) -> DataFrame:
    """Cells (keys, source, weight, value) of any number of sources: winner, delta, flag, provenance, confidence."""
    by = cells.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(F.col("weight").cast("double").alias("weight"), F.col("value").cast("double").alias("value"), "source")).alias("votes"))
    clusters = by.withColumn("clusters", vote_numeric(F.col("votes"), tolerance))
    total = F.aggregate("votes", F.lit(0.0), lambda s, v: s + v["weight"])
    best = F.array_max(F.transform("clusters", lambda c, i: F.struct(c["weight"].alias("weight"), (-i).alias("o"), c["anchor"].alias("anchor"))))
    out = clusters.withColumns({"__best": best, "__n": F.size("votes"), "__k": F.size("clusters"), "__total": total})
    delta = F.when(F.col("__k") == 1, 0.0).otherwise(1.0 - F.col("__best.weight") / F.col("__total"))
    out = out.withColumn("__delta", delta)
    return out.select(
        *keys, F.col("__best.anchor").alias("value"), F.round("__delta", 6).alias("delta"), F.col("__n").alias("n"), vote_flag(F.col("__delta"), F.col("__n")).alias("flag"),
        F.when((F.col("__k") == 1) & (F.col("__n") >= 2), "consensus").otherwise("ensemble").alias("provenance"), F.round(1 - F.col("__delta"), 3).alias("confidence"),
    )


def vote_labels(labels: DataFrame, keys, n_sources: int, lexicon: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Label of a row group: frequency and mean confidence weighed; a lexicon's words come first; two labels conflict."""
    by = labels.filter(F.col("term").isNotNull()).groupBy(*keys, "term").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    by = by.withColumn("score", config.label_alpha * F.col("n") / n_sources + (1 - config.label_alpha) * F.col("c"))
    if lexicon is not None:
        by = by.join(lexicon.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    else:
        by = by.withColumn("known", F.lit(None).cast("int"))
    return by.groupBy(*keys).agg(F.max_by("term", F.struct(F.coalesce("known", F.lit(0)), "score", "n")).alias("term"), (F.count("*") >= 2).alias("conflict"))


def table_quality(voted: DataFrame, keys) -> DataFrame:
    """1 less the mean disagreement of a table's cells, and the worst flag."""
    return voted.groupBy(*keys).agg(F.round(1 - F.avg("delta"), 6).alias("q_table"), flag_of(F.max(rank_flag(F.col("flag")))).alias("flag"), F.count("*").alias("cells"))


def table_rollup(rows: DataFrame, keys) -> DataFrame:
    """Match rate, rows that no dictionary knows, worst flag."""
    matched = F.col("match_type").isin("exact", "fuzzy", "resolved")
    return rows.groupBy(*keys).agg(F.avg(matched.cast("int")).alias("match_rate"), F.count_if(F.col("match_type").isin("custom", "grouped")).alias("custom_rows"), flag_of(F.max(rank_flag(F.col("flag")))).alias("flag"))


def pair_tables(a: DataFrame, b: DataFrame, keys=("doc_id", "table_idx")) -> DataFrame:
    """Tables of two sources by position: which side has them; extras pass through."""
    x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(True)), b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, list(keys), "full_outer").select(*keys, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def merge_rows(alignment: DataFrame, a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Rows of an alignment: the matched side is the base, a before b; two different terms are a red conflict, rows of b alone turn yellow."""
    keys = list(keys)
    side = lambda df, s: df.select(*keys, F.col("row_idx").alias(f"{s}_idx"), F.col("label").alias(f"{s}_label"), F.col("canonical").alias(f"{s}_term"), F.col("section").alias(f"{s}_section"))
    both = alignment.join(side(a, "a"), [*keys, "a_idx"], "left").join(side(b, "b"), [*keys, "b_idx"], "left")
    use_a = F.col("a_term").isNotNull() | (F.col("b_term").isNull() & F.col("a_idx").isNotNull())
    pick = lambda c: F.when(use_a, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    conflict = F.coalesce(F.col("a_term") != F.col("b_term"), F.lit(False))
    flag = F.when(conflict, "red").when(F.col("a_idx").isNull(), "yellow").otherwise("green")
    return both.select(*keys, "a_idx", "b_idx", "method", pick("label").alias("label"), pick("term").alias("canonical"), F.coalesce("a_section", "b_section").alias("section"), conflict.alias("conflict"), flag.alias("flag"))


def anchors(rows: DataFrame, weights: DataFrame, keys=("doc_id", "table_idx")) -> DataFrame:
    """(keys, source): each table's source of largest weight, then of most rows, then first by name."""
    by = rows.groupBy(*keys, "source").agg(F.count("*").alias("n")).join(dimension(weights), "source")
    w = W.partitionBy(*keys).orderBy(F.col("weight").desc(), F.col("n").desc(), "source")
    return by.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*keys, "source")


def row_groups(rows: DataFrame, weights: DataFrame, keys=("doc_id", "table_idx"), config: Config = DEFAULT) -> DataFrame:
    """rows with group_id: rows of other sources join the anchor's row that they align with, or are groups of their own."""
    keys = list(keys)
    anchor = rows.join(anchors(rows, weights, keys), [*keys, "source"], "left_semi")
    rest = rows.join(anchors(rows, weights, keys), [*keys, "source"], "left_anti")
    with_source = rest.select(*keys, "source").distinct()
    # every other source against a copy of the anchor's rows, keyed by that source
    copies = anchor.drop("source").join(with_source, keys)
    found = align_rows(copies, rest, [*keys, "source"], config).filter(F.col("b_idx").isNotNull())
    placed = found.select(*keys, "source", F.col("b_idx").alias("row_idx"), F.when(F.col("a_idx").isNotNull(), F.concat(F.lit("a:"), F.col("a_idx").cast("string"))).otherwise(F.concat_ws(":", "source", F.col("b_idx").cast("string"))).alias("group_id"))
    own = anchor.withColumn("group_id", F.concat(F.lit("a:"), F.col("row_idx").cast("string")))
    return own.unionByName(rest.join(placed, [*keys, "source", "row_idx"]))


def vote_groups(grouped: DataFrame, weights: DataFrame, keys=("doc_id", "table_idx")) -> DataFrame:
    """Row of a group: metadata of its heaviest labelled member, a subtotal if any member is one."""
    rows = grouped.join(dimension(weights), "source")
    best = F.struct(F.col("label").isNotNull().alias("named"), F.col("weight"))
    return rows.groupBy(*keys, "group_id").agg(F.max_by(F.struct("label", "canonical", "section"), best).alias("m"), F.bool_or("is_subtotal").alias("is_subtotal"), F.count("*").alias("members")).select(*keys, "group_id", "m.*", "is_subtotal", "members")


def ensemble(rows: DataFrame, cells: DataFrame, weights: DataFrame, keys=("doc_id", "table_idx"), tolerance: float = 1.0) -> DataFrame:
    """Any number of readings (rows, cells by source) voted cell by cell: (keys, group_id, col_name, winner and its flags)."""
    grouped = row_groups(rows, weights, keys).select(*keys, "source", "row_idx", "group_id")
    placed = cells.join(grouped, [*keys, "source", "row_idx"]).join(dimension(weights), "source")
    return vote_cells(placed, [*keys, "group_id", "col_name"], tolerance)


def arbitrate(voted: DataFrame, verdicts: DataFrame, keys) -> DataFrame:
    """Red numeric conflicts settled by an arbiter's verdicts (keys, verdict): yellow, provenance arbiter."""
    out = voted.join(verdicts.select(*keys, "verdict"), list(keys), "left")
    settled = (F.col("flag") == "red") & F.col("verdict").isNotNull()
    return out.withColumns({"value": F.when(settled, F.col("verdict")).otherwise(F.col("value")), "provenance": F.when(settled, "arbiter").otherwise(F.col("provenance")), "flag": F.when(settled, "yellow").otherwise(F.col("flag"))}).drop("verdict")


def union_columns(a: Column, b: Column) -> Column:
    """Column names of both rows, a's first, each once."""
    return F.array_distinct(F.concat(a, b))


def with_provenance(rows: DataFrame, provenance: str) -> DataFrame:
    return rows.withColumn("provenance", F.lit(provenance))
