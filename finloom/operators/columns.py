"""Which columns of a table hold labels, notes and figures, and in which layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text
from . import filters
from .filters import TABLE

# Header words by role, in order.
HEADERS = {
    "brut": ["brut", "montant brut", "valeur brute"],
    "amortissement": ["amort", "amortissement", "dépréciation", "amort. et dépréc.", "amort et deprec", "provisions"],
    "net": ["net", "valeur nette", "montant net"],
    "value_n": ["n", "exercice n", "exercice clos", "31/12/"],
    "value_n_minus_1": ["n-1", "exercice n-1", "exercice précédent", "31/12/", "exercice clos le"],
    "note": ["note", "notes", "réf", "ref"],
}
FIGURES = ("brut", "amortissement", "net", "value_n", "value_n_minus_1")


def header_roles(headers: DataFrame, cut: float = 70.0) -> DataFrame:
    """(table, role, col_idx) of headers (table, col_idx, col_name): each header's best role, each role's first column."""
    names = headers.select(F.lower(F.trim("col_name")).alias("name")).filter("name <> ''").distinct()
    # the fixed list of words goes along as an array: no join
    listed = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(w).alias("word"), F.lit(i).alias("ord")) for i, (r, ws) in enumerate(HEADERS.items()) for w in ws])
    pairs = names.withColumn("w", F.explode(listed)).select("name", "w.*")
    score = F.when(F.col("name") == F.col("word"), 100.0).otherwise(similarity.indel_ratio(F.col("name"), F.col("word")))
    best = pairs.withColumn("score", score).filter(F.col("score") >= cut).groupBy("name").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "role")).alias("b")).select("name", "b.role")
    own = headers.withColumn("name", F.lower(F.trim("col_name"))).join(best, "name")
    return own.groupBy(*TABLE, "role").agg(F.min("col_idx").alias("col_idx"))


def layout_of_roles(roles: Column, n_cols: Column) -> tuple[Column, Column]:
    """(model, confidence) of a table's set of roles."""
    has = lambda r: F.array_contains(roles, r)
    gross, years, both = has("brut") & has("net"), has("value_n") | has("value_n_minus_1"), has("value_n") & has("value_n_minus_1")
    model = F.when(gross, "brut_amort_net").when(years, "n_n1").when(n_cols == 2, "single").otherwise("unknown")
    confidence = F.when(gross & has("amortissement"), 0.95).when(gross, 0.85).when(both, 0.90).when(years, 0.75).when(n_cols == 2, 0.50).otherwise(0.0)
    return model, confidence


def label_column(cells: DataFrame) -> DataFrame:
    """(table, label_col): the column of longest text on average, the first of equals."""
    by = cells.filter(F.col("raw_value").isNotNull()).groupBy(*TABLE, "col_idx").agg(F.avg(F.length("raw_value")).alias("len"))
    return by.groupBy(*TABLE).agg(F.max_by("col_idx", F.struct("len", -F.col("col_idx"))).alias("label_col"))


def note_column(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(table, note_col): the first other column of very short strings."""
    width = F.length(F.trim("raw_value"))
    by = cells.filter(F.col("raw_value").isNotNull()).groupBy(*TABLE, "col_idx").agg(F.avg(width).alias("mean"), F.max(width).alias("most")).filter("mean <= 3 and most <= 5")
    return by.join(labels, list(TABLE)).filter("col_idx <> label_col").groupBy(*TABLE).agg(F.min("col_idx").alias("note_col"))


def identify(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table, model, confidence, label_col, note_col, numeric_cols): headers first, then the look of cells and their count."""
    keys = list(TABLE)
    roles = header_roles(headers).groupBy(*keys).agg(F.collect_set("role").alias("roles"), F.array_sort(F.collect_set(F.when(F.col("role").isin(*FIGURES), F.col("col_idx")))).alias("by_role"))
    shape = headers.groupBy(*keys).agg(F.count("*").alias("n_cols")).join(roles, keys, "left").withColumn("roles", F.coalesce("roles", F.expr("cast(array() as array<string>)")))
    model, confidence = layout_of_roles(F.col("roles"), F.col("n_cols"))
    known = shape.withColumns({"m": model, "c": confidence})
    looks = filters.numeric_looking_columns(cells).groupBy(*keys).agg(F.array_sort(F.collect_set("col_idx")).alias("by_look"))
    labels = label_column(cells)
    out = known.join(looks, keys, "left").join(labels, keys, "left").join(note_column(cells, labels), keys, "left")
    sure, n = F.col("c") >= 0.80, F.coalesce(F.size("by_look"), F.lit(0))
    return out.select(
        *keys,
        F.when(sure | (F.col("n_cols") < 2), F.col("m")).when((n >= 3) & (F.col("n_cols") >= 4), "brut_amort_net").when(n >= 1, "n_n1").otherwise("unknown").alias("model"),
        F.when(sure, F.col("c")).when(F.col("n_cols") < 2, 0.5).when((n >= 3) & (F.col("n_cols") >= 4), 0.60).when(n >= 1, 0.55).otherwise(0.30).alias("confidence"),
        "label_col",
        "note_col",
        F.when(sure & (F.size("by_role") > 0), F.col("by_role")).otherwise(F.col("by_look")).alias("numeric_cols"),
    )


def value_column(headers: DataFrame, numeric: DataFrame) -> DataFrame:
    """(table, value_col): the numeric column named net, else the first."""
    both = numeric.join(headers, [*TABLE, "col_idx"])
    is_net = F.lower(F.trim("col_name")) == "net"
    return both.groupBy(*TABLE).agg(F.min_by("col_idx", F.struct(~is_net, F.col("col_idx"))).alias("value_col"))


def table_labels(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table, label): headers, the first column, and the first five texts of the second without digits."""
    own = headers.select(*TABLE, F.col("col_name").alias("label"))
    first = cells.filter("col_idx = 0").select(*TABLE, F.col("raw_value").alias("label"))
    second = cells.filter((F.col("col_idx") == 1) & (F.col("row_idx") < 5) & ~text.has_digit(F.col("raw_value"))).select(*TABLE, F.col("raw_value").alias("label"))
    return own.unionByName(first).unionByName(second).filter(F.trim("label") != "")


def column_roles(layout: DataFrame) -> DataFrame:
    """(table, col_idx, role) of layouts with role_map (map<role, col_idx>)."""
    return layout.select(*TABLE, F.explode("role_map").alias("role", "col_idx"))


def dots_are_noise(cells: DataFrame) -> DataFrame:
    """(table, col_idx, noisy): columns most of whose large values have no dot, so that dots are reading errors."""
    large = F.regexp_replace("raw_value", r"[^\d]", "")
    by = cells.filter(F.length(large) >= 4).groupBy(*TABLE, "col_idx")
    dot = F.contains(F.col("raw_value"), F.lit("."))
    return by.agg((F.count_if(~dot) > F.count_if(dot)).alias("noisy"))
