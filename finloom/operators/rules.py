"""Validation rules as data: each check is a condition on key figures; reports are aggregates of their outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import numbers
from . import filters, ordered

CHECK = ("check_name", "passed", "severity", "message", "expected", "actual", "difference")


def check(name, passed: Column, severity: str, expected: Column, actual: Column, message: Column | None = None) -> list[Column]:
    """The columns of one check result."""
    name = F.lit(name) if isinstance(name, str) else name
    expected, actual = expected.cast("double"), actual.cast("double")
    return [
        name.alias("check_name"),
        passed.alias("passed"),
        F.lit(severity).alias("severity"),
        (F.lit("") if message is None else message).alias("message"),
        expected.alias("expected"),
        actual.alias("actual"),
        F.abs(expected - actual).alias("difference"),
    ]


def balance(rows: DataFrame, keys, relative: float = 0.01) -> DataFrame:
    """Assets against equity and liabilities: the last total of each kind; no assets, or assets of 0, give no check."""
    kind = rows.withColumn("kind", filters.row_type(F.col("label"))).filter(F.col("value").isNotNull())
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("row_idx")))
    by = kind.groupBy(*keys).agg(last("total_asset").alias("assets"), last("total_liability").alias("liabilities"), last("total_equity").alias("equity"), last("total_equity_and_liabilities").alias("both"))
    expected = F.coalesce("both", F.coalesce("liabilities", F.lit(0.0)) + F.coalesce("equity", F.lit(0.0)))
    passed = numbers.within(F.col("assets"), expected, relative=relative)
    return by.filter(F.coalesce("assets", F.lit(0.0)) != 0).select(*keys, *check("V1-001 Balance Sheet Balance", passed, "CRITICAL", expected, F.col("assets")))


def net_of_gross(rows: DataFrame, keys, relative: float = 0.01) -> DataFrame:
    """Net = gross - |depreciation|: up to three failures a table, or one check that all rows passed."""
    expected = F.col("brut") - F.abs(F.coalesce("amort", F.lit(0.0)))
    judged = rows.filter(F.col("brut").isNotNull() & F.col("net").isNotNull()).withColumns({"expected": expected, "ok": numbers.within(F.col("net"), expected, F.col("brut"), relative)})
    failed = first_n(judged.filter(~F.col("ok")), keys, 3)
    bad = failed.select(*keys, *check(F.concat(F.lit("V1-002 Net: "), F.substring("label", 1, 30)), F.lit(False), "ERROR", F.col("expected"), F.col("net")))
    clean = judged.groupBy(*keys).agg(F.bool_and("ok").alias("all")).filter("all")
    return bad.unionByName(clean.select(*keys, *check("V1-002 Net = gross - depreciation", F.lit(True), "ERROR", F.lit(None), F.lit(None))))


def first_n(rows: DataFrame, keys, n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("row_idx"))).filter(F.col("__r") <= n).drop("__r")


# Key words of key figures in order of priority, without accents.
FIGURES = {
    "operating": ["resultat d'exploitation"],
    "financial": ["resultat financier", "resultat des activites financieres"],
    "tax": ["impots sur les benefices", "impot sur les societes", "charge fiscale"],
    "net_income": ["resultat net", "resultat de l'exercice", "resultat net de l'exercice", "benefice net", "perte nette"],
    "revenue": ["chiffre d'affaires", "revenus", "ventes"],
    "bilan_net": ["resultat de l'exercice", "resultat net"],
    "bilan_cash": ["liquidites et equivalents", "tresorerie", "disponibilites", "liquidites"],
    "tft_cash": ["tresorerie de cloture", "tresorerie fin", "solde de cloture"],
    "equity": ["total des capitaux propres avant affectation", "total capitaux propres avant affectation", "total des capitaux propres et passifs", "total des capitaux propres", "total capitaux propres"],
    "long_term_debt": ["total des passifs non courants", "total passifs non courants"],
    "fixed_assets": ["total des actifs non courants", "total actifs non courants", "total actifs immobilises", "total des actifs immobilises"],
    "capital": ["capital social"],
    "fixed": ["immobilisations"],
    "stocks": ["stocks"],
}


def figure_words(spark) -> DataFrame:
    return spark.createDataFrame([(f, w, i) for f, words in FIGURES.items() for i, w in enumerate(words)], "figure string, keyword string, priority int")


def pivot_figures(figures: DataFrame, keys) -> DataFrame:
    """(keys, one column a figure) of (keys, figure, value)."""
    return figures.groupBy(*keys).agg(*[F.max(F.when(F.col("figure") == f, F.col("value"))).alias(f) for f in FIGURES])


def income_equation(wide: DataFrame, keys, relative: float = 0.01) -> DataFrame:
    """Net = operating + financial - |tax|, within a share of the operating result."""
    expected = F.col("operating") + F.coalesce("financial", F.lit(0.0)) - F.abs(F.coalesce("tax", F.lit(0.0)))
    given = wide.filter(F.col("operating").isNotNull() & F.col("net_income").isNotNull())
    return given.select(*keys, *check("V1-003 Income equation", numbers.within(F.col("net_income"), expected, F.col("operating"), relative), "CRITICAL", expected, F.col("net_income")))


def subtotals(rows: DataFrame, keys, relative: float = 0.01) -> DataFrame:
    sums = ordered.row_sums(rows, keys, relative=relative)
    return sums.select(*keys, *check(F.concat(F.lit("V1-004 Row Sum: "), F.substring("label", 1, 30)), F.col("passed"), "ERROR", F.col("expected"), F.col("actual")))


def variations(rows: DataFrame, keys, tolerance: float = 0.5) -> DataFrame:
    """Failures only, or one check that all variations were verified."""
    judged = ordered.variation_check(rows, tolerance)
    bad = judged.filter(~F.col("passed")).select(*keys, *check(F.concat(F.lit("V1-005 Var%: "), F.substring("label", 1, 25)), F.lit(False), "WARNING", F.col("expected"), F.col("reported")))
    clean = judged.groupBy(*keys).agg(F.bool_and("passed").alias("all")).filter("all")
    return bad.unionByName(clean.select(*keys, *check("V1-005 Variation %", F.lit(True), "WARNING", F.lit(None), F.lit(None))))


def field_types(cells: DataFrame, keys) -> DataFrame:
    """Cells of numeric columns that hold digits and no number."""
    raw = F.trim("raw_value")
    bad = (raw != "") & numbers.extract_numeric(F.col("raw_value")).isNull() & raw.rlike(r"\d") & ~F.lower(raw).rlike("total|note|exercice")
    by = cells.groupBy(*keys).agg(F.count_if(bad).alias("n"))
    return by.select(*keys, *check("V1-006 Field types", F.col("n") == 0, "WARNING", F.lit(0), F.col("n")))


def cross_statements(wide: DataFrame, keys, relative: float = 0.01) -> DataFrame:
    """Net income of balance sheet and income statement, cash of balance sheet and cash flow; columns bilan_*, cr_*, tft_*."""
    net = wide.filter(F.col("bilan_net").isNotNull() & F.col("cr_net").isNotNull())
    cash = wide.filter(F.col("bilan_cash").isNotNull() & F.col("tft_cash").isNotNull())
    one = net.select(*keys, *check("V2-001 Net income", numbers.within(F.col("cr_net"), F.col("bilan_net"), F.col("bilan_net"), relative), "CRITICAL", F.col("cr_net"), F.col("bilan_net")))
    two = cash.select(*keys, *check("V2-002 Closing cash", numbers.within(F.col("tft_cash"), F.col("bilan_cash"), F.col("bilan_cash"), relative), "CRITICAL", F.col("tft_cash"), F.col("bilan_cash")))
    return one.unionByName(two)


def anomalies(wide: DataFrame, keys) -> DataFrame:
    """Negative capital, fixed assets or stocks, and revenue of zero."""
    names = [c for c in ("capital", "fixed_assets", "fixed", "stocks") if c in wide.columns]
    negative = [wide.filter(F.col(c) < 0).select(*keys, *check(f"V3-001 Negative {c}", F.lit(False), "WARNING", F.lit(0), F.col(c))) for c in names]
    zero = wide.filter(F.col("revenue") == 0).select(*keys, *check("V3-002 Revenue is zero", F.lit(False), "WARNING", F.lit(None), F.col("revenue")))
    return reduce(DataFrame.unionByName, [*negative, zero])


def magnitude(rows: DataFrame, keys, spread: int = 6) -> DataFrame:
    """Values of a table that span more than six powers of ten, with at least three values."""
    size = F.when(F.abs("value") < 1, 0).otherwise(F.floor(F.log10(F.abs("value"))))
    by = rows.filter(F.col("value") != 0).groupBy(*keys).agg((F.max(size) - F.min(size)).alias("range"), F.count("*").alias("n"))
    return by.filter((F.col("n") >= 3) & (F.col("range") > spread)).select(*keys, *check("V3-003 Magnitude", F.lit(False), "WARNING", F.lit(spread), F.col("range")))


def working_capital(wide: DataFrame, keys) -> DataFrame:
    """Equity and long-term debt less fixed assets; missing figures are skipped, which counts as passed."""
    value = F.col("equity") + F.col("long_term_debt") - F.col("fixed_assets")
    return wide.select(*keys, *check("V4-001 Working capital", F.coalesce(value >= 0, F.lit(True)), "WARNING", F.lit(0), value, F.when(value.isNull(), "Skipped").otherwise("")))


def report(checks: DataFrame, keys, config: Config = DEFAULT) -> DataFrame:
    """Counts, critical failures, and the share of severity weights that passed."""
    weight = F.lit(1)
    for name, w in config.severity_weights.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    ok = F.col("passed")
    return checks.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
        F.count_if(~ok & (F.col("severity") == "CRITICAL")).alias("critical"),
        (F.sum(F.when(ok, weight).otherwise(0)) / F.sum(weight)).alias("score"),
    )


def _first_table(rows: DataFrame, keys, preferred: Column) -> DataFrame:
    """Rows of each document's first preferred table, or of its first table where none is."""
    first = rows.groupBy(*keys).agg(F.min(F.struct((~F.coalesce(preferred, F.lit(False))).alias("other"), F.col("table_idx").alias("t"))).alias("m")).select(*keys, F.col("m.t").alias("__t"))
    return rows.join(first, list(keys)).filter(F.col("table_idx") == F.col("__t")).drop("__t")


def _limited(checks: DataFrame, keys, n: int = 3) -> DataFrame:
    """The first n checks of each table, in the order of their rows."""
    w = W.partitionBy(*keys).orderBy("row_idx")
    return checks.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r", "row_idx")


def validate(rows: DataFrame, spark, keys=("doc_id",), config: Config = DEFAULT, gross: DataFrame | None = None, changes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """All rules over rows (keys, table_idx, row_idx, label, value, statement, and side where known), as one frame of checks.

    By table: balance and net of gross of balance sheets and unknown tables, the income equation of income statements and
    unknown tables, up to three row sums and three variations, field types, anomalies of the statement's own figures and
    the spread of magnitudes. By document: cross-statement checks where both statements are there (a balance sheet
    without a net income fails), and working capital. gross (keys, table_idx, row_idx, label, brut, amort, net), changes
    (..., current, prior, reported) and cells (keys, table_idx, raw_value) are checked where given.
    """
    from .match import keyword_values

    keys = list(keys)
    out = rows if "table_idx" in rows.columns else rows.withColumn("table_idx", F.lit(0))
    out = out if "side" in out.columns else out.withColumn("side", F.lit(None).cast("string"))
    table, statement, words = [*keys, "table_idx"], F.col("statement"), figure_words(spark)
    of = lambda *names: out.filter(statement.isin(*names))
    figures = lambda df, by: pivot_figures(keyword_values(df, words, by), by)
    bilan, cr, tft = of("bilan"), of("compte_resultat"), of("flux_tresorerie")
    sums = ordered.row_sums(out, table, relative=config.relative_tolerance)
    sums = sums.select(*table, "row_idx", *check(F.concat(F.lit("V1-004 Row Sum: "), F.substring("label", 1, 30)), F.col("passed"), "ERROR", F.col("expected"), F.col("actual")))
    parts = [
        balance(of("bilan", "unknown"), table, config.relative_tolerance),
        income_equation(figures(of("compte_resultat", "unknown"), table), table),
        _limited(sums, table),
        anomalies(figures(bilan, table).drop("fixed_assets").withColumn("revenue", F.lit(None).cast("double")), table),
        anomalies(figures(cr, table).drop("capital", "fixed_assets", "fixed", "stocks"), table),
        magnitude(out, table),
    ]
    known = out.select(*table, "statement").distinct()
    if gross is not None:
        parts.append(net_of_gross(gross.join(known.filter(statement.isin("bilan", "unknown")), table, "left_semi"), table, config.relative_tolerance))
    if changes is not None:
        judged = ordered.variation_check(changes, config.variation_tolerance)
        bad = judged.filter(~F.col("passed")).select(*table, "row_idx", *check(F.concat(F.lit("V1-005 Var%: "), F.substring("label", 1, 25)), F.lit(False), "WARNING", F.col("expected"), F.col("reported")))
        clean = judged.groupBy(*table).agg(F.bool_and("passed").alias("all")).filter("all")
        parts += [_limited(bad, table), clean.select(*table, *check("V1-005 Variation %", F.lit(True), "WARNING", F.lit(None), F.lit(None)))]
    if cells is not None:
        parts.append(field_types(cells, table))
    by_table = reduce(DataFrame.unionByName, parts)
    # across statements: net income from the liabilities' side, cash from the assets' side, where the sides are apart
    from_passif = figures(_first_table(bilan, keys, F.col("side") == "passif"), keys)
    from_actif = figures(_first_table(bilan, keys, F.col("side") == "actif"), keys)
    both = from_passif.select(*keys, "bilan_net", "equity", "long_term_debt").join(from_actif.select(*keys, "bilan_cash", "fixed_assets"), keys, "full")
    first = lambda df: _first_table(df, keys, F.lit(False))
    income = figures(first(cr), keys).select(*keys, F.col("net_income").alias("cr_net"), F.lit(True).alias("has_cr"))
    flows = figures(first(tft), keys).select(*keys, "tft_cash")
    wide = rows.select(*keys).distinct().join(both.withColumn("has_bilan", F.lit(True)), keys, "left").join(income, keys, "left").join(flows, keys, "left")
    absent = wide.filter(F.col("has_bilan") & F.col("has_cr") & (F.col("bilan_net").isNull() | F.col("cr_net").isNull()))
    by_document = [
        cross_statements(wide, keys, config.relative_tolerance),
        absent.select(*keys, *check("V2-001 Net income", F.lit(False), "CRITICAL", F.lit(None), F.lit(None), F.lit("not found"))),
        working_capital(wide, keys),
    ]
    found = rows.select(*keys).distinct().select(*keys, *check("Tables Found", F.lit(True), "CRITICAL", F.lit(None), F.lit(None)))
    apart = rows.groupBy(*keys).agg(F.bool_or(statement.isNotNull()).alias("some")).select(*keys, *check("Statement Segmentation", F.col("some"), "WARNING", F.lit(None), F.lit(None)))
    whole = reduce(DataFrame.unionByName, [*by_document, found, apart])
    return by_table.unionByName(whole.withColumn("table_idx", F.lit(None).cast("int")))


def bucket(name: Column) -> Column:
    """Tier of a check by its name."""
    low = F.lower(name)
    return (
        F.when(low.rlike("^v2|cross"), "V2").when(low.rlike("^v3|negative|anomal|magnitude"), "V3").when(low.rlike("^v4|ratio|working capital"), "V4").when(low.rlike("^v1|balance|row sum|var%|net"), "V1").otherwise("General")
    )


def suggested_quality(passed_all: Column, qcs: Column) -> Column:
    return F.when(passed_all & (qcs >= 0.85), "Excellent").when(passed_all & (qcs >= 0.75), "Good").when(passed_all, "Acceptable").otherwise("Needs Correction")
