"""Order-dependent operators: fill-down, subtotal groups, footing, page merges, variations, latest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.columns import computed_once

TABLE = ["doc_id", "source", "table_idx"]


def fill_down(df: DataFrame, column: str, keys, order) -> DataFrame:
    """Each row takes the last value at or above it."""
    up = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(up))


def heading_rows(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with is_heading: by font (bold, or 1.15 times the table's middle size) where fonts are known, else by capitals."""
    size = F.sort_array(F.collect_list("font_size").over(W.partitionBy(*TABLE)))
    middle = F.get(size, F.floor(F.size(size) / 2).cast("int"))
    by_font = F.coalesce(F.col("bold"), F.lit(False)) | (F.col("font_size") >= 1.15 * middle)
    by_caps = text.is_caps_heading(F.col(label)) & ~text.has_digit(F.col(label)) & F.char_length(F.trim(label)).between(3, 80)
    return rows.withColumn("is_heading", F.when(middle.isNotNull(), by_font).otherwise(by_caps))


def subtotal_groups(rows: DataFrame, keys=tuple(TABLE), order: str = "row_idx") -> DataFrame:
    """grp: number of subtotals above the row, so children and their subtotal share it."""
    above = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("grp", F.coalesce(F.sum(F.col("is_subtotal").cast("int")).over(above), F.lit(0)))


def footing(rows: DataFrame, keys=tuple(TABLE), tolerance: float = 1.0) -> DataFrame:
    """Subtotal rows with expected (sum of the children in the same section), actual and valid; NULL without children or value."""
    grouped = subtotal_groups(rows, keys)
    child = grouped.filter(~F.col("is_subtotal"))
    sums = child.groupBy(*keys, "grp", F.col("section").alias("child_section")).agg(F.sum("value").alias("expected"), F.count("value").alias("children"))
    totals = grouped.filter("is_subtotal").withColumnRenamed("value", "actual")
    same = [totals[k].eqNullSafe(sums[k]) for k in keys] + [totals["grp"] == sums["grp"], totals["section"].eqNullSafe(sums["child_section"])]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = totals.join(sums, cond, "left").select(totals["*"], "expected", "children")
    return joined.withColumn("valid", F.when(F.col("children") > 0, F.abs(F.col("actual") - F.col("expected")) <= tolerance))


def row_sums(rows: DataFrame, keys=tuple(TABLE), reach: int = 19, relative: float = 0.01) -> DataFrame:
    """Total rows against the sum of the rows since the previous total, at most reach of them, at least two."""
    is_total = F.lower("label").rlike("total|somme")
    marked = rows.withColumn("is_total", is_total)
    above = W.partitionBy(*keys).orderBy("row_idx").rowsBetween(W.unboundedPreceding, -1)
    grouped = marked.withColumn("grp", F.coalesce(F.sum(F.col("is_total").cast("int")).over(above), F.lit(0)))
    first = F.greatest(F.lit(0), F.col("row_idx") - 20)
    parts = grouped.filter(~F.col("is_total") & F.col("value").isNotNull()).select(*keys, "grp", F.col("row_idx").alias("part"), F.col("value").alias("part_value"))
    totals = grouped.filter(F.col("is_total") & (F.col("value") != 0)).withColumn("low", first)
    joined = totals.join(parts, [*keys, "grp"]).filter((F.col("part") > F.col("low")) & (F.col("part") < F.col("row_idx")))
    out = joined.groupBy(*keys, "row_idx", "label", F.col("value").alias("expected")).agg(F.sum("part_value").alias("actual"), F.count("*").alias("components"))
    return out.filter("components >= 2").withColumn("passed", numbers.within(F.col("expected"), F.col("actual"), relative=relative))


def session_groups(df: DataFrame, keys, order: str, breaks: Column, name: str = "session") -> DataFrame:
    """Running number of the session: breaks says where a new one begins (it may use lag over the same window)."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("__break", F.coalesce(breaks.cast("int"), F.lit(1))).withColumn(name, F.sum("__break").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__break")


# Words of header rows and of rows that close a section.
HEADER_WORDS, CLOSING_WORDS = ("total", "brut", "amort", "net", "n-1", "exercice", "note"), ("total", "sous-total", "total des")


def continuation_score(columns_a: Column, columns_b: Column, offsets_a: Column, offsets_b: Column, first_b: Column, labels_a: Column, likeness: Column) -> dict[str, Column]:
    """The four signals that a table continues the one before, their sum, and whether its first row repeats the header.

    columns: names; offsets: left edges; first_b: the first row's text; labels_a: the first column's last three texts;
    likeness: token-sorted ratio of the joined names of a and the first row of b.
    """
    n = F.least(F.size(offsets_a), F.size(offsets_b))
    near = F.size(F.filter(F.arrays_zip(F.slice(offsets_a, 1, F.greatest(n, F.lit(0))).alias("a"), F.slice(offsets_b, 1, F.greatest(n, F.lit(0))).alias("b")), lambda x: F.abs(x["a"] - x["b"]) < 5))
    unknown = offsets_a.isNull() | offsets_b.isNull() | (n <= 0)
    repeated = likeness >= 85
    worded = reduce(lambda a, b: a | b, [F.contains(F.lower(first_b), F.lit(w)) for w in HEADER_WORDS])
    closed = F.exists(labels_a, lambda x: F.contains(F.lower(x), F.lit("total")))
    out = {
        "same_columns": (F.size(columns_a) == F.size(columns_b)).cast("double"),
        "aligned": F.when(unknown, 0.5).otherwise((F.try_divide(near, n) >= 0.8).cast("double")),
        "same_header": F.when(first_b.isNull(), 0.0).when(repeated, 1.0).when(worded, 0.0).otherwise(0.5),
        "open_section": F.when(F.size(labels_a) == 0, 0.0).otherwise((~closed).cast("double")),
    }
    out["score"] = reduce(lambda a, b: a + b, out.values())
    out["repeats_header"] = F.coalesce(repeated, F.lit(False))
    return out


def merge_pages(tables: DataFrame, cut: float = 2.5) -> DataFrame:
    """(doc_id, merged, row_idx, cells): the fragments of tables (doc_id, page, table_idx, columns array, x_offsets array or
    NULL, rows array of arrays) put together where a fragment continues the table so far on the page before.

    A fragment whose first row repeats the header loses it; its cells go under the names of the table so far, by place.
    A fold over a document's tables in page order: a document is the unit, its tables are few.
    """
    from ..functions.similarity import token_sort_ratio

    joined = lambda a: F.array_join(F.transform(a, lambda x: F.coalesce(x, F.lit(""))), " ")
    w = W.partitionBy("doc_id").orderBy("page", "table_idx")
    text_of = tables.withColumns({"first": joined(F.get("rows", F.lit(0)))})
    # a table's header is that of the fragment which began it: scores against every header in the document's order
    listed = text_of.withColumn("n", F.row_number().over(w))
    heads = listed.select("doc_id", F.col("n").alias("h"), joined(F.col("columns")).alias("head"))
    pairs = listed.filter(F.size("rows") > 0).select("doc_id", "n", "first").join(heads, "doc_id").filter("h < n")
    like = pairs.withColumn("like", token_sort_ratio(F.col("head"), F.col("first"))).groupBy("doc_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "like"))), lambda x: x["like"]).alias("like"))
    each = listed.join(like, ["doc_id", "n"], "left")
    item = F.struct("n", "page", "columns", "x_offsets", "rows", "first", "like")
    by = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    last3 = lambda rows: F.transform(F.when(F.size(rows) > 3, F.slice(rows, -3, 3)).otherwise(rows), lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")))

    def step(done: Column, t: Column) -> Column:
        now = F.try_element_at(done, F.lit(-1))
        likeness = F.coalesce(F.get(t["like"], now["n"] - 1), F.lit(0.0))
        signals = continuation_score(now["columns"], t["columns"], now["x_offsets"], t["x_offsets"], t["first"], last3(now["rows"]), likeness)
        goes_on = (F.size(done) > 0) & F.coalesce((t["page"] - now["page"] <= 1) & (signals["score"] >= cut), F.lit(False))
        rows = F.when(signals["repeats_header"] & (F.size(t["rows"]) > 1), F.slice(t["rows"], 2, F.greatest(F.size(t["rows"]) - 1, F.lit(0)))).otherwise(t["rows"])
        grown = F.struct(now["n"].alias("n"), t["page"].alias("page"), now["columns"].alias("columns"), now["x_offsets"].alias("x_offsets"), F.concat(now["rows"], rows).alias("rows"))
        fresh = F.struct(t["n"].alias("n"), t["page"].alias("page"), t["columns"].alias("columns"), t["x_offsets"].alias("x_offsets"), t["rows"].alias("rows"))
        return F.when(goes_on, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    empty = F.filter(F.transform("t", lambda t: F.struct(t["n"].alias("n"), t["page"].alias("page"), t["columns"].alias("columns"), t["x_offsets"].alias("x_offsets"), t["rows"].alias("rows"))), lambda t: F.lit(False))
    merged = by.select("doc_id", F.posexplode(F.aggregate("t", empty, step)).alias("merged", "m"))
    rows = merged.select("doc_id", "merged", "m.columns", F.posexplode("m.rows").alias("row_idx", "r"))
    return rows.select("doc_id", "merged", "row_idx", F.zip_with(F.slice("columns", 1, F.least(F.size("columns"), F.size("r"))), F.slice("r", 1, F.least(F.size("columns"), F.size("r"))), lambda c, v: F.struct(c.alias("name"), v.alias("value"))).alias("cells"))


def latest(df: DataFrame, keys, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def variation_check(rows: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Rows (label, current, prior, reported) whose reported change in percent is off, with expected and difference."""
    given = rows.filter(F.col("current").isNotNull() & F.col("prior").isNotNull() & F.col("reported").isNotNull() & (F.col("prior") != 0))
    out = given.withColumn("expected", numbers.variation(F.col("current"), F.col("prior")))
    return out.withColumn("difference", F.abs(F.col("reported") - F.col("expected"))).withColumn("passed", F.col("difference") <= tolerance)


def correct_variation(rows: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Reported changes that are missing or more than tolerance points off are written anew, in French form."""
    reported = numbers.extract_numeric(F.col("variation"))
    expected = numbers.variation(F.col("current"), F.col("prior"))
    wrong = expected.isNotNull() & (reported.isNull() | (F.abs(reported - expected) > tolerance))
    return rows.withColumns({"corrected": wrong, "variation": F.when(wrong, numbers.french_percent(expected)).otherwise(F.col("variation"))})


def explode_merged_rows(rows: DataFrame, keys, columns, parts: int = 3) -> DataFrame:
    """Rows in which a cell holds several lines become one row a line; shorter cells pad with '', single values repeat."""
    parts_of = {c: f"__parts_{i}" for i, c in enumerate(columns)}
    split = rows.select(*keys, *columns)
    for c, name in parts_of.items():  # once a row: the lambda below only picks from arrays
        split = computed_once(split, name, F.split(F.coalesce(F.col(c), F.lit("")), "\n"))
    most = F.greatest(*[F.size(n) for n in parts_of.values()], F.lit(1))
    split = split.withColumn("__n", F.when(most >= parts, most).otherwise(1))

    def cell(c: str, i: Column) -> Column:
        own = F.col(parts_of[c])
        return F.when((F.col("__n") == 1) | (F.size(own) == 1), F.col(c)).otherwise(F.coalesce(F.get(own, i), F.lit("")))

    lines = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.struct(*[cell(c, i).alias(c) for c in columns]))
    return split.select(*keys, F.posexplode(lines).alias("line", "__cells")).select(*keys, "line", *[F.col(f"__cells.{c}").alias(c) for c in columns])
