"""Enrichment of classified rows, the acceptance gate and the cascade of tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import numbers, text
from ..storage import stored
from . import columns, filters, match, ordered


def green_flag(match_rate: Column, parse_failures: Column, column_confidence: Column, footing_ok: Column, class_confidence: Column, config: Config = DEFAULT) -> dict[str, Column]:
    """Five gates and the reasons of those that fail; an unknown footing passes."""
    gates = {
        "match_rate": match_rate >= config.green_match,
        "parse_failures": parse_failures <= 0,
        "column_confidence": column_confidence >= config.green_columns,
        "footing": F.coalesce(footing_ok, F.lit(True)),
        "class_confidence": class_confidence >= config.green_class,
    }
    out = {f"gate_{i}": g for i, g in enumerate(gates.values(), 1)}
    out["reasons"] = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]))
    out["green"] = F.size(out["reasons"]) == 0
    return out


def unmatched_kind(label: Column, section: Column) -> Column:
    """Rows without a match: empty, header, grouped under their section, or custom."""
    return F.when(F.trim(F.coalesce(label, F.lit(""))) == "", "empty").when(text.is_caps_heading(label), "header").when(section.isNotNull(), "grouped").otherwise("custom")


def enrich(
    rows: DataFrame, cells: DataFrame, terms: DataFrame, sections: list[tuple[str, str]], keys=tuple(ordered.TABLE), config: Config = DEFAULT, headers: DataFrame | None = None, approved: DataFrame | None = None, customs: DataFrame | None = None
) -> DataFrame:
    """rows (keys, row_idx, label) with section, canonical, match_type, is_subtotal, value, footing, flag and grouped_from.

    Sections come from headings and fill down. With headers (keys, col_idx, col_name) the columns are identified first:
    which hold figures, and in which layout; else numeric columns are told by their cells. Lost characters are resolved,
    then labels are matched among the terms of their section. Rows without a match are classed; grouped ones name their
    section's heading. The figures of all numeric columns are read, the first one gives the value; subtotals are checked
    against their children: a failed one turns yellow, and so does a row with a cell that cannot be read. The statement
    is that of the table's labels.
    """
    keys = list(keys)
    headed = rows.withColumn("section", F.when(text.is_caps_heading(F.col("label")), match.classify_section(F.col("label"), sections)))
    headed = headed.withColumn("__heading", F.when(F.col("section").isNotNull(), F.col("label")))
    filled = stored(ordered.fill_down(ordered.fill_down(headed, "section", keys, ["row_idx"]), "__heading", keys, ["row_idx"]), "sections")
    # lost characters first: matching sees what they resolve to
    resolved = match.wildcard_join(filled, terms, config=config).filter("hits > 0").select(F.col("label").alias("__raw"), F.col("best").alias("__best"))
    asked = filled.withColumnRenamed("label", "__raw").join(resolved, "__raw", "left").withColumn("label", F.coalesce("__best", "__raw")).drop("__best")
    matched = match.fuzzy_match(asked, terms, approved, customs, config).withColumn("label", F.col("__raw")).drop("__raw")
    if headers is not None:
        layout = columns.identify(cells, headers)
        numeric = layout.select(*keys, F.explode("numeric_cols").alias("col_idx"), F.col("model").alias("column_model"), F.col("confidence").alias("column_confidence"))
    else:
        numeric = filters.numeric_columns(cells).filter("col_idx > 0").select(*keys, "col_idx", F.lit("unknown").alias("column_model"), F.lit(0.80).alias("column_confidence"))
    read = cells.join(numeric, [*keys, "col_idx"]).withColumn("parsed", numbers.parse_french(F.col("raw_value")))
    unread = F.coalesce((F.trim("raw_value") != "") & F.col("parsed").isNull(), F.lit(False))
    figures = read.groupBy(*keys, "row_idx").agg(
        F.min_by("parsed", "col_idx").alias("value"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_idx", "parsed")))).alias("figures"),
        F.count_if(unread).alias("unread"),
        F.count("parsed").alias("read"),
        F.first("column_model").alias("column_model"),
        F.first("column_confidence").alias("column_confidence"),
    )
    valued = matched.join(figures, [*keys, "row_idx"], "left")
    marked = stored(valued.withColumn("is_subtotal", filters.subtotal(F.col("label"), F.lit(False))), "rows")
    foot = ordered.footing(marked, keys).select(*keys, "row_idx", "expected", F.col("valid").alias("footing_valid"))
    out = stored(marked.join(foot, [*keys, "row_idx"], "left"), "rows")
    voted = out.join(match.dimension(terms.select("canonical", F.col("statement").alias("__st")).groupBy("canonical").agg(F.first("__st").alias("__st"))), "canonical", "left")
    stated = match.segments(voted.select(*keys, "label", "match_type", F.col("__st").alias("statement")), keys).select(*keys, F.col("statement").alias("table_statement"), F.col("confidence").alias("statement_confidence"))
    kind = F.when(F.col("match_type").isin("custom", "unrecognized"), unmatched_kind(F.col("label"), F.col("section"))).otherwise(F.col("match_type"))
    yellow = (F.coalesce(F.col("unread"), F.lit(0)) > 0) | F.coalesce(~F.col("footing_valid"), F.lit(False))
    final = out.join(stated, keys, "left").withColumns({"row_kind": kind, "flag": F.when(yellow, "yellow").otherwise("green")})
    return final.withColumns({"grouped_from": F.when(F.col("row_kind") == "grouped", F.col("__heading")), "provenance": F.lit("tier0")}).drop("__heading")


def gate_inputs(enriched: DataFrame, keys=("doc_id",)) -> DataFrame:
    """What the acceptance gate asks of each document: match rate, unread cells by read ones, the best confidence of its
    tables' columns, the best match rate of a table as confidence of the class, and whether all footings hold."""
    keys = list(keys)
    hit = F.col("match_type").isin("exact", "fuzzy", "resolved").cast("int")
    table = [*keys, *[c for c in ordered.TABLE if c not in keys]]
    by_table = enriched.groupBy(*table).agg(
        F.sum(hit).alias("hits"), F.count("*").alias("n"), F.avg(hit).alias("rate"), F.sum(F.coalesce("unread", F.lit(0))).alias("unread"), F.sum(F.coalesce("read", F.lit(0))).alias("read"),
        F.max("column_confidence").alias("columns"), F.bool_and("footing_valid").alias("foot"),
    )
    return by_table.groupBy(*keys).agg(
        (F.sum("hits") / F.sum("n")).alias("match_rate"),
        (F.sum("unread") / F.greatest(F.sum("read"), F.lit(1))).alias("parse_failures"),
        F.coalesce(F.max("columns"), F.lit(0.80)).alias("column_confidence"),
        F.max("rate").alias("class_confidence"),
        F.bool_and("foot").alias("footing_ok"),
    )


def conflict_totals(cells: DataFrame, alignments: DataFrame, keys=("doc_id",)) -> DataFrame:
    """(keys, conflicts, coverage): conflicts of a document's merged cells (table_idx, conflict), and the mean coverage of
    its tables' alignments (table_idx, a_idx, b_idx)."""
    from .align import coverage

    conflicts = cells.groupBy(*keys).agg(F.count_if("conflict").alias("conflicts"))
    mean = coverage(alignments, [*keys, "table_idx"]).groupBy(*keys).agg(F.avg("coverage").alias("coverage"))
    return conflicts.join(mean, list(keys), "left")


def first_tier(native: DataFrame, optical: DataFrame, native_text: DataFrame, optical_text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first tier's cells and texts: optical tables with the native ones that they lack by position; the native text
    (doc_id, text) for scoring where there is any, as it has no reading errors."""
    from .align import supplement

    texts = optical_text.select("doc_id", F.col("text").alias("o")).join(native_text.select("doc_id", F.col("text").alias("n")), "doc_id", "left")
    return supplement(optical, native), texts.select("doc_id", F.when(F.trim("n") != "", F.col("n")).otherwise(F.col("o")).alias("text"))


def cascade(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """docs (category, confidence, green, qcs0, qcs1, qcs3, critical3) with tier, status and the attempts that were made.

    Rejected before any work (-1); native text if flagged green and excellent (0); fast reading if good (1); the middle
    tier is a stub that never accepts; the ensemble if good and without critical failures (3); else human review (4).
    """
    rejected = (F.col("category") == "Autre") | (F.col("confidence") < config.class_confidence)
    zero = F.col("green") & (F.col("qcs0") >= config.tier0_accept)
    one = F.col("qcs1") >= config.tier1_accept
    three = (F.col("qcs3") >= config.tier1_accept) & (F.col("critical3") == 0)
    tier = F.when(rejected, -1).when(zero, 0).when(one, 1).when(F.coalesce(three, F.lit(False)), 3).otherwise(4)
    attempt = lambda t, score: F.struct(F.lit(t).alias("tier"), score.cast("double").alias("score"))
    tried = F.array_compact(
        F.array(
            F.when(~rejected, attempt(0, F.col("qcs0"))),
            F.when(~rejected & ~zero, attempt(1, F.col("qcs1"))),
            F.when(~rejected & ~zero & ~one, attempt(2, F.lit(0.0))),
            F.when(~rejected & ~zero & ~one, attempt(3, F.col("qcs3"))),
        )
    )
    status = F.when(tier == -1, "REJECTED").when(tier == 4, "REVIEW").otherwise("ACCEPTED")
    return docs.withColumns({"tier": tier, "status": status, "attempts": tried})


def ensemble_route(tables: DataFrame, keys=("doc_id",), cut: float = 0.75) -> DataFrame:
    """Documents accepted by their worst voted table and without critical failure."""
    return tables.groupBy(*keys).agg(F.min("q_table").alias("q"), F.bool_or("critical").alias("critical")).withColumn("accepted", (F.col("q") >= cut) & ~F.col("critical"))
