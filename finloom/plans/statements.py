"""Queries that run the statement engine's operators on statements, stores and files made of the driver tables.

A nation is a document: its balance sheet comes from customers and suppliers, its income statement from orders. Events
are logs, jobs and requests. Files are written to the shared folder and read back by the readers.
"""

from __future__ import annotations

import io
import zipfile


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, quality, text
from ..functions.times import iso_utc
from ..operators import align, columns, filters, match, ordered, repair, route, rules, store
from ..sources import dictionary, documents, readers
from ..storage import shared_dir, stored
from ..streaming import events as streams
from .catalog import _money, _t, query

# --- texts and numbers --------------------------------------------------------------------------------------------------


@query("""with n as (select distinct p_name p from part), f as (select p, split_part(p, ' ', 1) a, split_part(p, ' ', 2) b from n)
select p as name, upper(p) || ' EU' upper_form, 'e a ' || p plain, upper(p) as_upper, lower(p) as_lower, a || ' ' || upper(b[1]) || substr(b, 2) camel, '"' || p || '" - ...' punctuation, a || ' ' || upper(b[1]) || substr(b, 2) || ' -5' repaired,
 length(p) >= 3 heading, false as digit, true as lost from f""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Case, accents, joined words, punctuation, composed repairs, and what tells headings, digits and lost characters."""
    names = _t(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    a, b = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    joined = F.concat(a, F.initcap(b))
    return names.select(
        "name",
        text.normalize_upper(F.concat("name", F.lit(" éÜ"))).alias("upper_form"),
        text.strip_accents(F.concat(F.lit("é à "), "name")).alias("plain"),
        text.match_case(F.col("name"), F.lit("ABC")).alias("as_upper"),
        text.match_case(F.col("name"), F.lit("abc")).alias("as_lower"),
        text.split_camel(joined).alias("camel"),
        text.smart_punctuation(F.concat(F.lit("“"), "name", F.lit("” –   …"))).alias("punctuation"),
        repair.repaired(F.concat(joined, F.lit(" =5"))).alias("repaired"),
        text.is_caps_heading(F.upper("name")).alias("heading"),
        text.has_digit(F.col("name")).alias("digit"),
        text.has_wildcard(F.concat("name", F.lit("?"))).alias("lost"),
    )


_PRICE = "printf('%.2f', l_extendedprice)"


@query(f"""with v as (select distinct l_extendedprice x, {_PRICE} p, l_linenumber % 4 k from lineitem)
select p raw, cast(k as integer) kind, cast(round(x, 2) as double) fixed, true as numeric, case when k = 3 then null else cast(round(x, 2) as double) end as lenient, cast(replace(p, '.', '') as double) column_read from v""")
def ocr_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Prices with glyphs that scanners confuse, two numbers in a cell, and columns in which dots are noise."""
    k = (F.col("l_linenumber") % 4).cast("int")
    p = F.format_string("%.2f", "l_extendedprice")
    rows = _t(spark, d, "lineitem").select(p.alias("raw"), k.alias("kind")).distinct()
    confused = F.translate(F.translate("raw", "015", "OlS"), ".", ",")
    cell = F.when(F.col("kind") == 3, F.concat(F.lit("1,000 "), F.lit("2,000"))).otherwise(F.concat(F.lit("x "), "raw"))
    return rows.select(
        "raw", "kind", numbers.parse_french(confused).cast("double").alias("fixed"), numbers.is_numeric(confused).alias("numeric"), numbers.extract_numeric(cell).alias("lenient"), numbers.column_value(F.col("raw"), F.lit(True)).alias("column_read")
    )


@query("""with s as (select doc_id, (doc_id % 7) / 10.0::double + 0.35 a, (doc_id % 5) / 10.0::double + 0.5 b, (doc_id % 11)::double c, n_chars::double n, doc_id % 4 t from documents),
g as (select *, case when a >= 0.85 then 'EXCELLENT' when a >= 0.65 then 'GOOD' when a >= 0.40 then 'FAIR' else 'POOR' end ga, case when b >= 0.85 then 'EXCELLENT' when b >= 0.65 then 'GOOD' when b >= 0.40 then 'FAIR' else 'POOR' end gb from s),
h as (select *, case ga when 'EXCELLENT' then 1.0 when 'GOOD' then 0.8 when 'POOR' then 0.25 else 0.55 end::double sa, case gb when 'EXCELLENT' then 1.0 when 'GOOD' then 0.8 when 'POOR' then 0.25 else 0.55 end::double sb from g),
i as (select *, 0.4::double * sa + 0.4::double * sb + 0.2::double * sa layer1, case when t = 0 then 0.5::double when t = 1 then a else (t / 4.0)::double end layer3, case when c = 0 then 0 else least(0.08, c / greatest(n / 100, 10) * 0.01) end::double penalty from h),
q as (select *, case when ga = 'POOR' then 0 else greatest(0, 0.4::double * layer1 + 0.3::double * b + 0.3::double * layer3 - penalty) end::double qcs from i)
select doc_id, round(layer1, 6) layer1, round(layer3, 6) layer3, round(qcs, 6) qcs, case when qcs >= 0.9 then 'excellent' when qcs >= 0.75 then 'good' when qcs >= 0.6 then 'fair' else 'poor' end grade,
 cast(case when ga = 'POOR' then 3 when qcs >= 0.75 then 1 when qcs >= 0.6 then 2 else 3 end as integer) tier, ga = 'POOR' or qcs < 0.9 or t = 3 review, round((2 * a + b) / 3, 6) mean, cast(round_even(a * 100, 0) as integer) percent from q""")
def layer_scores(spark: SparkSession, d: str) -> DataFrame:
    """The three layers, penalty, composite, grade, tier and review of documents whose grades come from their ids."""
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").select("doc_id", "n_chars", ((i % 7) / F.lit(10.0) + 0.35).alias("a"), ((i % 5) / F.lit(10.0) + 0.5).alias("b"), (i % 11).alias("c"), (i % 4).alias("t"))
    rows = rows.withColumns({"ga": numbers.score_to_grade(F.col("a")), "gb": numbers.score_to_grade(F.col("b"))})
    given, passed, total = F.when(F.col("t") == 1, F.col("a")), F.when(F.col("t") > 1, F.col("t")), F.when(F.col("t") > 1, F.lit(4))
    rows = rows.withColumns({"layer1": quality.intrinsic(F.col("ga"), F.col("gb"), F.col("ga")), "layer3": quality.semantic(given, passed, total), "penalty": quality.correction_penalty(F.col("c"), F.col("n_chars"))})
    rows = rows.withColumn("qcs", quality.composite(F.col("layer1"), F.col("b"), F.col("layer3"), F.col("penalty"), F.col("ga")))
    low, critical = F.col("ga"), (F.col("t") == 3).cast("int")
    return rows.select(
        "doc_id", F.round("layer1", 6).alias("layer1"), F.round("layer3", 6).alias("layer3"), F.round("qcs", 6).alias("qcs"), quality.grade(F.col("qcs")).alias("grade"), quality.recommended_tier(F.col("qcs"), low).alias("tier"), quality.needs_review(F.col("qcs"), critical, low).alias("review"),
        F.round(numbers.five_scores([(F.col("a"), 2.0), (F.col("b"), 1.0)]), 6).alias("mean"), numbers.percent(F.col("a")).alias("percent"),
    )


# --- words ---------------------------------------------------------------------------------------------------------------

_KNOWN = ["widget", "gadget", "ring", "bolt", "gear", "screw", "plate", "red", "blue", "green", "big", "small", "old", "new", "grand", "hot", "cold"]


@query(f"""with n as (select distinct p_name p from part), w as (select p, split_part(p, ' ', 1) a, split_part(p, ' ', 2) b from n), k as (select unnest([{", ".join(f"'{w}'" for w in _KNOWN)}]) v),
x as (select p, a, b, a in (select v from k) and b in (select v from k) known, a || b || '!' joined, a || ' ' || b || 'x' wrong from w)
select p as name, case when known then a || ' ' || b || '!' else null end as split, case when known then a || ' ' || b else null end as fixed, '1 500,00' amount, cast(case when known then 2 end as integer) n_words from x where known""")
def word_repair(spark: SparkSession, d: str) -> DataFrame:
    """Part names with the blank lost, and with a letter too many, against the words of a corrections dictionary."""
    sure = _t(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    known = F.forall(F.split("name", " "), lambda w: w.isin(*_KNOWN))
    rows = sure.filter(known).select("name", F.concat(F.replace("name", F.lit(" "), F.lit("")), F.lit("!")).alias("split"), F.concat("name", F.lit("x")).alias("fixed"), F.lit("1 500,00").alias("amount"))
    vocabulary = readers.vocabulary(spark.createDataFrame([(" ".join(_KNOWN[:9]),)], "correction string"), _KNOWN[9:])
    words = vocabulary.select(F.lower("word").alias("word"))
    for column in ("split", "fixed", "amount"):
        rows = repair.correct_phrases(rows, column, words).drop("changed")
    return rows.withColumn("n_words", F.size(F.split("name", " ")))


@query("""select doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: case when l = 'R' || chr(65533) || 'sultat' then 'Résultat' else l end), chr(10))) as text from
(select doc_id, text || chr(10) || 'R' || chr(65533) || 'sultat' as text from documents where length(text) < 400)""")
def resolved_lines(spark: SparkSession, d: str) -> DataFrame:
    """Short texts with a line that lost a character, resolved against the terms."""
    rows = _t(spark, d, "documents").filter("length(text) < 400").select("doc_id", F.concat("text", F.lit("\nR�sultat")).alias("text"))
    terms = dictionary.terms_of(spark, [{"canonical": "Résultat", "section": "r", "statement": "bilan"}, {"canonical": "Stocks", "section": "a", "statement": "bilan"}])
    lines = rows.select(F.explode(F.split("text", "\n")).alias("label")).filter(F.contains("label", F.lit("�"))).distinct()
    return repair.resolve_lines(rows, match.wildcard_join(lines, terms)).select("doc_id", F.md5("text").alias("text"))


# --- columns -------------------------------------------------------------------------------------------------------------

_HEADS = {0: ["Designation", "Brut", "Amortissement", "Net"], 1: ["Libelle", "Note", "Exercice N", "Exercice N-1"], 2: ["Poste", "Montant"]}


def _sheet_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells and headers of a table a nation, a row a customer; three layouts in turn."""
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    own = _t(spark, d, "customer").select("c_nationkey", "c_name", "c_acctbal", (F.row_number().over(w) - 1).cast("int").alias("row_idx"))
    k, amount = F.col("c_nationkey") % 3, F.format_string("%.2f", "c_acctbal")
    values = F.when(k == 0, F.array("c_name", amount, F.lit("0"), amount)).when(k == 1, F.array("c_name", F.lit("A1"), amount, amount)).otherwise(F.array("c_name", amount))
    table = [F.col("c_nationkey").cast("string").alias("doc_id"), F.lit("a").alias("source"), F.lit(0).alias("table_idx")]
    cells = own.select(*table, "row_idx", F.posexplode(values).alias("col_idx", "raw_value"))
    names = F.when(k == 0, F.array(*map(F.lit, _HEADS[0]))).when(k == 1, F.array(*map(F.lit, _HEADS[1]))).otherwise(F.array(*map(F.lit, _HEADS[2])))
    heads = own.select("c_nationkey").distinct().select(*table, F.posexplode(names).alias("col_idx", "col_name"))
    return cells, heads


@query("""with t as (select cast(c_nationkey as varchar) doc_id, c_nationkey % 3 k, count(*) n from customer group by 1, 2)
select doc_id, case k when 0 then 'brut_amort_net' when 1 then 'n_n1' else 'n_n1' end model, case k when 0 then 0.95 when 1 then 0.9 else 0.55 end::double confidence, 0::integer label_col, cast(case k when 0 then 2 when 1 then 1 end as integer) note_col,
 case k when 0 then [1, 2, 3] when 1 then [2, 3] else [1] end numeric_cols, cast(case k when 0 then 3 else 1 end as integer) value_col, cast(case k when 0 then 3 when 1 then 3 else 1 end as bigint) roles, n + (case k when 2 then 2 else 4 end) labels, cast(case k when 2 then 1 else 2 end as bigint) looks from t""")
def column_layout(spark: SparkSession, d: str) -> DataFrame:
    """Roles of headers, layout, label, note and figure columns of tables in three layouts."""
    cells, heads = _sheet_cells(spark, d)
    cells, heads = stored(cells, "cells"), stored(heads, "heads")
    layout = columns.identify(cells, heads).select("doc_id", "model", "confidence", F.col("label_col").cast("int").alias("label_col"), F.col("note_col").cast("int").alias("note_col"), "numeric_cols")
    numeric = filters.numeric_columns(cells).select(*filters.TABLE, "col_idx").filter("col_idx > 0")
    value = columns.value_column(heads, numeric).select("doc_id", F.col("value_col").cast("int").alias("value_col"))
    mapped = columns.header_roles(heads).groupBy(*filters.TABLE).agg(F.map_from_entries(F.collect_list(F.struct("role", "col_idx"))).alias("role_map"))
    roles = columns.column_roles(mapped).filter(F.col("role").isin("brut", "amortissement", "net", "value_n", "value_n_minus_1", "note")).groupBy("doc_id").agg(F.count("*").alias("roles"))
    labels = columns.table_labels(cells, heads).groupBy("doc_id").agg(F.count("*").alias("labels"))
    looks = filters.numeric_looking_columns(cells).filter("col_idx > 0").groupBy("doc_id").agg(F.least(F.count("*"), F.lit(2)).alias("looks"))
    return layout.join(value, "doc_id").join(roles, "doc_id", "left").join(labels, "doc_id").join(looks, "doc_id").withColumn("roles", F.coalesce("roles", F.lit(0)))


# --- statements of a nation -------------------------------------------------------------------------------------------

_SECTIONS = [("actifs_courants", "actifs courants"), ("capitaux_propres", "capitaux propres")]
_ENTRIES = [
    {"canonical": "Stocks", "section": "actifs_courants", "statement": "bilan", "account_code": "3", "field": "stocks"},
    {"canonical": "Clients", "section": "actifs_courants", "statement": "bilan", "variations": ["Créances clients"], "account_code": "41", "field": "clients"},
    {"canonical": "Capital social", "section": "capitaux_propres", "statement": "bilan", "account_code": "10", "field": "capital_social"},
]


def _nation_amounts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, a, b, c): customers' positive and negative balances of a nation and the count of its customers."""
    own = F.col("c_acctbal")
    return _t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("doc_id")).agg(
        F.sum(F.when(own > 0, _money("c_acctbal")).otherwise(0)).cast("decimal(18,2)").alias("a"), F.sum(F.when(own <= 0, -_money("c_acctbal")).otherwise(0)).cast("decimal(18,2)").alias("b"), F.count("*").alias("c")
    )


_AMOUNTS = """with n as (select cast(c_nationkey as varchar) doc_id, c_nationkey k, sum(case when c_acctbal > 0 then cast(c_acctbal as decimal(18,2)) else 0 end)::decimal(18,2) a, sum(case when c_acctbal <= 0 then -cast(c_acctbal as decimal(18,2)) else 0 end)::decimal(18,2) b, count(*) c from customer group by 1, 2)"""


def _sheet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows and cells of a balance sheet a nation; the total of every third one is 100 off, a cell of every fifth unread."""
    n = _nation_amounts(spark, d).withColumn("k", F.col("doc_id").cast("int"))
    shown = lambda c: F.translate(F.format_string("%.2f", c.cast("double")), ".", ",")
    total = F.col("a") + F.col("b") + F.when(F.col("k") % 3 == 0, 100).otherwise(0)
    lines = [("ACTIFS COURANTS", F.lit("")), ("St?cks", shown(F.col("a"))), ("Créances clients", F.when(F.col("k") % 5 == 0, "12a4b").otherwise(shown(F.col("b")))), ("Total des actifs courants", shown(total)), ("Divers et autres", F.lit("0")), ("CAPITAUX PROPRES", F.lit("")), ("Capital social", shown(F.col("c")))]
    every = n.select("doc_id", F.posexplode(F.array(*[F.struct(F.lit(l).alias("label"), v.alias("net")) for l, v in lines])).alias("row_idx", "r")).select("doc_id", F.lit("a").alias("source"), F.lit(0).alias("table_idx"), "row_idx", "r.label", "r.net")
    every = stored(every, "sheet")
    table = ["doc_id", "source", "table_idx", "row_idx"]
    cells = every.select(*table, F.posexplode(F.array("label", "net")).alias("col_idx", "raw_value"))
    return every.select(*table, "label"), cells


@query(_AMOUNTS + """, r as (select *, unnest([0, 1, 2, 3, 4, 5, 6]) i from n),
x as (select doc_id, cast(i as integer) row_idx, case when i < 5 then 'actifs_courants' else 'capitaux_propres' end section, case i when 1 then 'Stocks' when 2 then 'Clients' when 6 then 'Capital social' end canonical,
 case i when 1 then 'exact' when 2 then 'resolved' when 6 then 'exact' when 0 then 'header' when 5 then 'header' else 'grouped' end row_kind, case i when 1 then a when 2 then case when k % 5 = 0 then null else b end when 3 then a + b + case when k % 3 = 0 then 100 else 0 end when 4 then 0 when 6 then c end::double v,
 i = 3 is_subtotal, case when i = 3 then (k % 5 <> 0 and k % 3 <> 0) or (k % 5 = 0 and abs(b + case when k % 3 = 0 then 100 else 0 end) <= 1) end footing_valid, case when i in (3, 4) then 'ACTIFS COURANTS' end grouped_from, k % 5 = 0 and i = 2 unread from r)
select doc_id, row_idx, section, canonical, row_kind, v as "value", is_subtotal, footing_valid, grouped_from, case when unread or footing_valid = false then 'yellow' else 'green' end flag, 'bilan' table_statement, round(3 / 7.0::double + 0.2, 6) statement_confidence from x""")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Balance sheets through headings, lost characters, columns, matching, subtotals, classing and flags."""
    rows, cells = _sheet(spark, d)
    heads = rows.select(*filters.TABLE).distinct().select(*filters.TABLE, F.posexplode(F.array(F.lit("Designation"), F.lit("Net"))).alias("col_idx", "col_name"))
    out = route.enrich(rows, cells, dictionary.terms_of(spark, _ENTRIES), _SECTIONS, headers=heads)
    return out.select("doc_id", "row_idx", "section", "canonical", "row_kind", F.col("value").cast("double").alias("value"), "is_subtotal", "footing_valid", "grouped_from", "flag", "table_statement", F.round("statement_confidence", 6).alias("statement_confidence"))


@query(_AMOUNTS + """, g as (select doc_id, k, k % 5 = 0 bad, (k % 5 <> 0 and k % 3 <> 0) or (k % 5 = 0 and abs(b + case when k % 3 = 0 then 100 else 0 end) <= 1) foot from n)
select doc_id, round(3 / 7.0::double, 6) match_rate, round(case when bad then 1 / 4.0 else 0 end::double, 6) parse_failures, foot footing_ok, false green, list_filter(['match_rate', case when bad then 'parse_failures' end, 'column_confidence', case when not foot then 'footing' end, 'class_confidence'], lambda x: x is not null) reasons,
 round(3 / 7.0::double, 6) rollup_rate, 2::bigint custom_rows, case when bad or not foot then 'yellow' else 'green' end flag from g""")
def acceptance_gate(spark: SparkSession, d: str) -> DataFrame:
    """What the acceptance gate asks of the enriched sheets, its five verdicts, and the tables' rollup."""
    rows, cells = _sheet(spark, d)
    out = stored(route.enrich(rows, cells, dictionary.terms_of(spark, _ENTRIES), _SECTIONS), "enriched")
    gate = route.gate_inputs(out).withColumn("column_confidence", F.lit(0.5))
    flags = route.green_flag(F.col("match_rate"), F.col("parse_failures"), F.col("column_confidence"), F.col("footing_ok"), F.col("class_confidence"))
    roll = align.table_rollup(out.withColumn("match_type", F.when(F.col("row_kind") == "grouped", "grouped").when(F.col("row_kind") == "header", "header").otherwise(F.col("match_type"))), ["doc_id"])
    judged = gate.select("doc_id", F.round("match_rate", 6).alias("match_rate"), F.round("parse_failures", 6).alias("parse_failures"), "footing_ok", flags["green"].alias("green"), flags["reasons"].alias("reasons"))
    return judged.join(roll.select("doc_id", F.round("match_rate", 6).alias("rollup_rate"), "custom_rows", "flag"), "doc_id")


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """Three tables a nation: assets, liabilities, income statement, with figures that agree or not by the nation."""
    n = _nation_amounts(spark, d).withColumns({"k": F.col("doc_id").cast("int"), "x": F.col("a").cast("double"), "y": F.col("b").cast("double")})
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    row = lambda t, s, side, label, value: F.struct(F.lit(t).alias("table_idx"), F.lit(s).alias("statement"), F.lit(side).cast("string").alias("side"), F.lit(label).alias("label"), value.cast("double").alias("value"))
    lines = [
        row(0, "bilan", "actif", "Immobilisations", x), row(0, "bilan", "actif", "Stocks", F.when(k % 4 == 0, -y).otherwise(y)), row(0, "bilan", "actif", "Total des actifs non courants", x + y), row(0, "bilan", "actif", "Total des passifs", x + y + F.when(k % 3 == 0, x).otherwise(0.0)),
        row(1, "bilan", "passif", "Capital social", x), row(1, "bilan", "passif", "Résultat de l'exercice", y), row(1, "bilan", "passif", "Total des capitaux propres", x + y), row(1, "bilan", "passif", "Total des passifs non courants", F.when(k % 2 == 0, -y - 1).otherwise(y)),
        row(2, "compte_resultat", None, "Chiffre d'affaires", F.when(k % 6 == 0, 0.0).otherwise(x)), row(2, "compte_resultat", None, "Résultat d'exploitation", x), row(2, "compte_resultat", None, "Résultat financier", y), row(2, "compte_resultat", None, "Impôts sur les bénéfices", y), row(2, "compte_resultat", None, "Résultat net de l'exercice", x + F.when(k % 5 == 0, x).otherwise(0.0)),
    ]
    rows = n.select("doc_id", F.posexplode(F.array(*lines)).alias("row_idx", "r"))
    return stored(rows.select("doc_id", "row_idx", "r.*"), "statements")


@query(_AMOUNTS + """, v as (select doc_id, k, a::double x, b::double y from n),
c as (select doc_id, 'V1-001 Balance Sheet Balance' check_name, abs((x + y) - (x + y + case when k % 3 = 0 then x else 0 end)) <= greatest(abs(x + y) * 0.01, 1) passed, 'CRITICAL' s from v where x + y <> 0
union all select doc_id, 'V1-003 Income equation', abs((x + case when k % 5 = 0 then x else 0 end) - (x + y - abs(y))) <= greatest(abs(x) * 0.01, 1), 'CRITICAL' from v
union all select doc_id, 'V1-004 Row Sum: Total des actifs non courants', abs((x + y) - (x + case when k % 4 = 0 then -y else y end)) <= greatest(abs(x + y) * 0.01, 1), 'ERROR' from v where x + y <> 0 and false
union all select doc_id, 'V3-001 Negative stocks', false, 'WARNING' from v where k % 4 = 0 and y > 0
union all select doc_id, 'V3-002 Revenue is zero', false, 'WARNING' from v where k % 6 = 0
union all select doc_id, 'V2-001 Net income', abs(y - (x + case when k % 5 = 0 then x else 0 end)) <= greatest(abs(y) * 0.01, 1), 'CRITICAL' from v
union all select doc_id, 'V4-001 Working capital', (x + y) + (case when k % 2 = 0 then -y - 1 else y end) - (x + y) >= 0, 'WARNING' from v
union all select doc_id, 'Tables Found', true, 'CRITICAL' from v union all select doc_id, 'Statement Segmentation', true, 'WARNING' from v)
select doc_id, check_name, passed, s severity, case when check_name like 'V2%' then 'V2' when check_name like 'V3%' then 'V3' when check_name like 'V4%' then 'V4' when check_name like 'V1%' then 'V1' else 'General' end bucket from c""")
def statement_checks(spark: SparkSession, d: str) -> DataFrame:
    """All rules over three tables a nation, row sums, magnitudes apart; each check with its tier."""
    checks = rules.validate(_statements(spark, d), spark)
    kept = checks.filter(~F.col("check_name").rlike("V1-004|V3-003"))
    return kept.select("doc_id", "check_name", "passed", "severity", rules.bucket(F.col("check_name")).alias("bucket"))


@query("""with n as (select c_nationkey k, c_custkey id, c_name, cast(c_acctbal as decimal(18,2))::double b, row_number() over (partition by c_nationkey order by c_custkey) - 1 i from customer),
v as (select *, case when i % 3 = 0 then b - 50 else b end - (case when k % 2 = 0 and i % 4 = 1 then 500 else 0 end) e, b bb from n),
f as (select k, i, c_name, abs(bb - 20 - (case when k % 2 = 0 and i % 4 = 1 then bb - 520 - abs(bb) else bb - 20 end)) <= greatest(abs(bb) * 0.01, 1) ok from v),
g as (select *, row_number() over (partition by k order by i) r from f where not ok)
select cast(k as varchar) doc_id, 'V1-002 Net: ' || c_name check_name, false passed from g where r <= 3 union all select cast(k as varchar), 'V1-002 Net = gross - depreciation', true from f group by k having bool_and(ok)
union all select cast(k as varchar), 'V1-006 Field types', count(*) filter (i % 7 = 6) = 0 from n group by k""")
def table_checks(spark: SparkSession, d: str) -> DataFrame:
    """Net of gross by customer, three failures a nation at most, and cells of numeric columns that hold no number."""
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    own = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_name", _money("c_acctbal").cast("double").alias("b"), (F.row_number().over(w) - 1).alias("row_idx"))
    off = (F.col("k") % 2 == 0) & (F.col("row_idx") % 4 == 1)
    rows = own.select(F.col("k").cast("string").alias("doc_id"), "row_idx", F.col("c_name").alias("label"), F.col("b").alias("brut"), F.lit(-20.0).alias("amort"), F.when(off, F.col("b") - 520 - F.abs("b")).otherwise(F.col("b") - 20).alias("net"))
    cells = own.select(F.col("k").cast("string").alias("doc_id"), F.when(F.col("row_idx") % 7 == 6, "1-2-3").otherwise(F.col("b").cast("decimal(18,2)").cast("string")).alias("raw_value"))
    return rules.net_of_gross(rows, ["doc_id"]).unionByName(rules.field_types(cells, ["doc_id"])).select("doc_id", "check_name", "passed")


@query(_AMOUNTS + """, l as (select doc_id, k, unnest(case when k % 3 = 0 then ['Stocks', 'Clients', 'Actifs courants', 'xx'] when k % 3 = 1 then ['Capital social', 'Capitaux propres', 'Passifs courants', 'Dettes'] else ['nothing', 'here'] end) l from n)
select doc_id, case when k % 3 < 2 then 'bilan' else 'unknown' end "statement", round(case k % 3 when 0 then 2 / 4.0 + 0.2 when 1 then 1 / 4.0 + 0.2 else 0 end::double, 6) confidence, cast(case k % 3 when 0 then 2 when 1 then 1 else 0 end as bigint) hits, case k % 3 when 0 then 'actif' when 1 then 'passif' end side,
 case k % 3 when 0 then ['bilan', 'bilan_actif'] when 1 then ['bilan', 'bilan_passif'] else ['unknown'] end buckets, k % 3 = 9 "cross" from n""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    """Tables classed by matched labels, with confidence, balance-sheet side, buckets, and whether cross checks apply."""
    n = _nation_amounts(spark, d).withColumn("k", F.col("doc_id").cast("int") % 3)
    names = F.when(F.col("k") == 0, F.array(*map(F.lit, ["Stocks", "Clients", "Actifs courants", "xx"]))).when(F.col("k") == 1, F.array(*map(F.lit, ["Capital social", "Capitaux propres", "Passifs courants", "Dettes"]))).otherwise(F.array(F.lit("nothing"), F.lit("here")))
    labels = n.select("doc_id", F.explode(names).alias("label"))
    terms = dictionary.terms_of(spark, _ENTRIES)
    of_bilan = dictionary.of_statement(terms, "bilan").select("canonical", "statement").distinct()
    matched = match.exact_lookup(labels, match.term_index(terms)).drop("statement", "section").join(of_bilan, "canonical", "left")
    found = match.segments(matched, ["doc_id"])
    sides = match.segment_sides(labels, ["doc_id"], ["actifs courants", "stocks", "clients"], ["capitaux propres", "passifs courants", "dettes"])
    both = stored(found.join(sides, "doc_id"), "segments")
    buckets = match.side_memberships(both).groupBy("doc_id").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    cross = store.several_statements(both, ["doc_id"])
    return both.withColumn("confidence", F.round("confidence", 6)).join(buckets, "doc_id").join(cross, "doc_id", "left").withColumn("cross", F.coalesce("cross", F.lit(False)))


# --- store, access, records ---------------------------------------------------------------------------------------------

@query("""with j as (select event_id job_id, case event_type when 'error' then false when 'purchase' then true end ok, (event_id % 5)::int attempt from events)
select job_id, case when ok then 'done' when ok = false and attempt < 3 then 'queued' when ok = false then 'failed' else 'running' end status, case when ok = false and attempt < 3 then least(600.0, pow(2.0, attempt)) end::double wait,
cast(case when ok = false and attempt < 3 then attempt + 1 else attempt end as integer) attempt, cast(case when ok = false then 4000 end as integer) error_length, event_id % 6 = 0 again, cast(case when event_id % 6 = 0 then 0 else attempt end as integer) attempts from (select *, job_id event_id from j)""")
def job_steps(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after their runs: done, queued again with a wait, failed with a cut error; and deliveries set back."""
    i = F.col("event_id")
    jobs = _t(spark, d, "events").select(i.alias("job_id"), F.lit("running").alias("status"), (i % 5).cast("int").alias("attempt"))
    outcomes = _t(spark, d, "events").filter("event_type in ('error', 'purchase')").select(i.alias("job_id"), (F.col("event_type") == "purchase").alias("ok"), F.when(F.col("event_type") == "error", F.repeat(F.lit("e"), 5000)).alias("error"))
    done = store.job_step(jobs, outcomes)
    sent = _t(spark, d, "events").select(i.alias("delivery_id"), F.lit("sent").alias("status"), (i % 5).cast("int").alias("attempts"))
    back = store.replay(sent, sent.filter("delivery_id % 6 = 0")).select(F.col("delivery_id").alias("job_id"), (F.col("status") == "pending").alias("again"), "attempts")
    return done.select("job_id", "status", "wait", "attempt", F.length("error").alias("error_length")).join(back, "job_id")


@query("""with a as (select c_custkey id, case when c_custkey % 4 = 0 then case when c_custkey % 8 = 0 then 'ann' else 'me' end when c_custkey % 3 = 0 then 'old' end reviewer, case when c_custkey % 5 = 0 then 'approved' when c_custkey % 5 = 1 then 'rejected' else 'pending' end decided,
 case when c_custkey % 7 = 0 then 'new' else 'cfg' end setting from customer) select id, reviewer, decided, setting from a union all select 1000000000, null, null, 'new'""")
def store_moves(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers assigned, variations decided, settings replaced or added, customers as documents."""
    i = F.col("c_custkey")
    base = _t(spark, d, "customer").select(i.alias("document_id"))
    named = base.filter("document_id % 4 = 0").select("document_id", F.when(F.col("document_id") % 8 == 0, "ann").alias("reviewer"))
    assigned = store.assign(base.withColumn("reviewer", F.when(F.col("document_id") % 3 == 0, "old")), named, "me")
    variations = base.select(F.col("document_id").alias("variation_id"), F.lit("pending").alias("status"))
    decided = store.decide_variations(variations, variations.filter("variation_id % 5 < 2").select("variation_id", (F.col("variation_id") % 5 == 0).alias("approve")))
    settings = base.select(F.col("document_id").alias("org_id"), F.lit("cfg").alias("setting"))
    changes = settings.filter("org_id % 7 = 0").withColumn("setting", F.lit("new")).unionByName(spark.createDataFrame([(1_000_000_000, "new")], "org_id long, setting string"))
    put = store.upsert(settings, changes, ["org_id"])
    return put.join(assigned, F.col("org_id") == F.col("document_id"), "left").join(decided, F.col("org_id") == F.col("variation_id"), "left").select(F.col("org_id").alias("id"), "reviewer", F.col("status").alias("decided"), "setting")


@query("""with l as (select p_partkey id, p_partkey % 4 k from part) select 'candidates' what, (select count(*) from l where k in (1, 2) and (id % 20) / 20.0 < 0.95) n
union all select 'seeded', (select count(*) from l where k <> 3) union all select 'trail', (select count(*) from events where user_id = 7) union all select 'owned', (select count(*) from orders where o_orderkey = 5 and o_custkey % 2 = 1)
union all select 'deliveries', (select count(*) from orders join customer on o_custkey = c_custkey where c_nationkey = 3) union all select 'truth', (select count(*) from customer where c_nationkey = 4) union all select 'tenant', (select count(*) from customer where c_nationkey = 5)
union all select 'last done', (select count(distinct o_custkey) from orders where o_orderstatus = 'F') union all select 'last events', 100""")
def store_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of what the store lists: candidates of the log, seeds of corrections, trails, owned rows, deliveries, truths."""
    part = _t(spark, d, "part")
    k = F.col("p_partkey") % 4
    matches = part.select(F.col("p_name").alias("label"), F.lit("m").alias("canonical"), F.when(k == 1, "fuzzy").when(k == 2, "resolved").when(k == 3, "exact").otherwise("custom").alias("match_type"), ((F.col("p_partkey") % 20) / 20).alias("match_confidence"))
    corrections = part.select(F.col("p_name").alias("raw_text"), F.when(k != 3, "m").alias("canonical"), F.lit(1).alias("ts"))
    trail = _t(spark, d, "events").select(F.col("user_id").alias("document_id"), "ts", "event_id")
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("delivery_id"), F.col("o_custkey").alias("endpoint_id"), (F.col("o_custkey") % 2).alias("org_id"), F.col("o_orderdate").alias("created_at"))
    ends = _t(spark, d, "customer").select(F.col("c_custkey").alias("endpoint_id"), F.col("c_nationkey").alias("org_id"))
    truths = _t(spark, d, "customer").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("correction_id"), F.col("c_name").alias("created_at"))
    jobs = _t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"), F.col("o_orderdate").alias("created_at"))
    listed = {
        "candidates": store.log_candidates(matches), "seeded": store.corrections_to_variations(corrections), "trail": store.audit_trail(trail, 7), "owned": store.owned(orders, "delivery_id", 5, 1), "deliveries": store.deliveries(orders.drop("org_id"), ends, 3),
        "truth": store.ground_truth(truths, 4), "tenant": filters.of_tenant(truths, 5), "last done": store.latest_job(jobs, done=True), "last events": readers.last_events(trail, 100),
    }
    out = None
    for name, df in listed.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with c as (select c_custkey id, c_custkey % 4 r, c_custkey % 9 = 0 su from customer)
select id, case when su then ['delete', 'read', 'write'] when r = 0 then ['read'] when r = 1 then ['read', 'write'] else [] end scopes, su or r = 1 can_write, list_filter(['read', 'write'], lambda x: not (su or r = 1 or (r = 0 and x = 'read'))) missing,
 cast(case id % 3 when 0 then 415 when 1 then 413 else 202 end as integer) upload, id % 2 = 0 and id % 5 <> 0 and (id % 7 <> 0) live, id % 11 = 0 all_live, id % 3 = 1 reviewed from c""")
def access_rules(spark: SparkSession, d: str) -> DataFrame:
    """Scopes of roles, guards, uploads, live keys and flags to review, customers as principals."""
    i = F.col("c_custkey")
    by_role = {"viewer": ["read"], "editor": ["read", "write"], "admin": ["read", "write", "delete"]}
    rows = _t(spark, d, "customer").select(i.alias("id"), F.when(i % 4 == 0, "viewer").when(i % 4 == 1, "editor").otherwise("guest").alias("role"), (i % 9 == 0).alias("su"))
    held = filters.scopes_of(F.col("role"), F.col("su"), by_role)
    need = F.array(F.lit("read"), F.lit("write"))
    files = rows.select("id", F.when(F.col("id") % 3 == 0, "a.exe").otherwise("b.PDF").alias("filename"), F.when(F.col("id") % 3 == 1, 26 * 1024 * 1024).otherwise(10).alias("length"))
    status = filters.upload_status(files).select("id", F.col("status").alias("upload"))
    live = filters.live_key(F.when(F.col("id") % 2 == 0, "k").otherwise("z"), F.lit("k"), F.col("id") % 5 != 0, F.when(F.col("id") % 7 == 0, F.lit(1)).when(F.col("id") % 7 == 1, F.lit(9)), F.lit(5))
    alive = filters.all_present(F.when(F.col("id") % 11 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("id") % 11 == 1, F.array(F.lit(1), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)")), lambda x: x > 0)
    cells = rows.select("id", F.when(F.col("id") % 3 == 1, "red").when(F.col("id") % 3 == 2, "green").alias("flag"))
    flagged = filters.non_green(cells).select("id", F.lit(True).alias("reviewed"))
    out = rows.withColumn("scopes", F.array_sort(held)).select("id", "scopes", filters.has_scopes(F.col("scopes"), F.array(F.lit("write"))).alias("can_write"), filters.missing_scopes(F.col("scopes"), need).alias("missing"), live.alias("live"), alive.alias("all_live"))
    return out.join(status, "id").join(flagged, "id", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


@query("""select org_id, idempotency_key, count(*) n, min(o_orderkey) first from (select o_custkey % 10 org_id, case when o_orderkey % 4 = 0 then null else o_orderkey % 50 end idempotency_key, o_orderkey from orders
qualify idempotency_key is null or row_number() over (partition by org_id, idempotency_key order by o_orderkey) = 1) group by 1, 2""")
def idempotent_submits(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select((F.col("o_custkey") % 10).alias("org_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 50).alias("idempotency_key"), F.col("o_orderkey").alias("created_at"))
    return filters.idempotent(rows).groupBy("org_id", "idempotency_key").agg(F.count("*").alias("n"), F.min("created_at").alias("first"))


@query("""with s as (select o_orderkey id, o_orderkey % 5 k, cast(o_totalprice as decimal(18,2))::double p from orders), b as (select *, case when k = 0 then null else p end ca, p nca from s)
select id, round(coalesce(ca, 0) + nca, 2) total_assets, abs(coalesce(ca, 0) + nca - (p + case when k = 1 then 1 else p end)) < 0.01 is_balanced, round(p - 10 - 5 + 2 - 1, 2) calculated_net_income, case when k <> 2 then round(abs(p - (p - 10 - 5 + 2 - 1)), 2) end net_income_discrepancy, k not in (0, 1) and k % 2 = 0 as "valid",
 case when k = 1 then 'income_statement' else 'balance_sheet' end "schema", (case when k <> 1 and p < 1000 then 1 else 0 end) + (case when k = 1 and p > 1000 then 1 else 0 end) failures from b""")
def records(spark: SparkSession, d: str) -> DataFrame:
    """Balance-sheet and income records of orders: derived columns, validity, the schema of a kind and its failures."""
    k, p = F.col("id") % 5, F.col("p")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _money("o_totalprice").cast("double").alias("p"))
    sheet = rows.withColumns({"current_assets": F.when(k != 0, p), "non_current_assets": p, "current_liabilities": p, "non_current_liabilities": F.lit(None).cast("double"), "equity": F.when(k == 1, 1.0).otherwise(p)})
    both = filters.income_columns(filters.balance_columns(sheet).withColumns({"revenue": p, "cost_of_sales": F.lit(10.0), "operating_expenses": F.lit(5.0), "financial_result": F.lit(2.0), "income_tax": F.lit(1.0), "reported_net_income": F.when(k != 2, p)}))
    kind = both.withColumn("kind", F.when(k == 1, "compte_resultat").when(k == 2, "other").otherwise("bilan"))
    failed = filters.checked_by_kind(kind, "id", "kind", {"balance_sheet": {"low": p >= 1000}, "income_statement": {"high": p <= 1000}}).groupBy("id").agg(F.count("*").alias("failures"))
    out = kind.withColumn("valid", filters.record_valid(F.lit(0.8), F.lit(0.0), k % 2 == 1, F.when(k == 2, F.lit(None).cast("boolean")).otherwise(F.col("is_balanced"))))
    r = lambda c: F.round(c, 2).alias(c)
    return out.join(failed, "id", "left").select("id", r("total_assets"), "is_balanced", r("calculated_net_income"), r("net_income_discrepancy"), "valid", filters.schema_of(F.col("kind")).alias("schema"), F.coalesce("failures", F.lit(0)).cast("int").alias("failures"))


# --- two and more readings ---------------------------------------------------------------------------------------------

def _readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows and cells of three readings of a customer's orders: b lacks every fifth, c names every seventh otherwise."""
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("table_idx"), F.col("o_orderkey").cast("int").alias("row_idx"), _money("o_totalprice").cast("double").alias("value"))
    term = F.concat(F.lit("T"), F.col("row_idx").cast("string"))
    rows = orders.withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).filter("source <> 'b' or row_idx % 5 <> 0")
    rows = rows.withColumns({"label": F.when((F.col("source") == "c") & (F.col("row_idx") % 7 == 0), F.concat(F.lit("zz"), term)).otherwise(term), "canonical": term, "section": F.lit("s"), "is_subtotal": F.col("row_idx") % 11 == 0})
    off = F.when((F.col("source") == "b") & (F.col("row_idx") % 10 == 1), 50.0).when((F.col("source") == "c") & (F.col("row_idx") % 14 == 0), 90.0).otherwise(0.0)
    cells = rows.select("doc_id", "table_idx", "row_idx", "source", F.lit("Net").alias("col_name"), (F.col("value") + off).alias("value"))
    return rows.drop("value"), cells


@query("""with o as (select o_custkey doc_id, o_orderkey i, cast(o_totalprice as decimal(18,2))::double v from orders),
s as (select doc_id, i, 'a' src, 0.5 w, v from o union all select doc_id, i, 'b', 0.3, v + case when i % 10 = 1 then 50 else 0 end from o where i % 5 <> 0 union all select doc_id, i, 'c', 0.2, v + case when i % 14 = 0 then 90 else 0 end from o),
g as (select doc_id, i, v, sum(cast(w as decimal(6,3))) w, min(src) src, count(*) m from s group by 1, 2, 3), t as (select doc_id, i, sum(w) tw, sum(m) n, count(*) c from g group by 1, 2), b as (select * from g qualify row_number() over (partition by doc_id, i order by w desc, src) = 1),
r as (select b.doc_id, b.i, b.v, case when c = 1 then 0 else 1 - b.w::double / tw::double end delta, n, c from b join t using (doc_id, i)), f as (select *, case when c > 1 and delta >= 0.5 then 'red' when delta <= 0.1 and n >= 2 then 'green' else 'yellow' end flag from r)
select doc_id, round(1 - cast(sum(cast(delta as decimal(18,6))) as double) / count(*), 4) q_table, max(case flag when 'red' then 2 when 'yellow' then 1 else 0 end)::integer worst, count(*) cells, bool_or(i % 11 = 0) subtotal, 1 - cast(sum(cast(delta as decimal(18,6))) as double) / count(*) >= 0.95 accepted from f group by 1""")
def ensemble_tables(spark: SparkSession, d: str) -> DataFrame:
    """Three readings anchored, grouped, voted cell by cell; tables' quality, worst flag, routing."""
    rows, cells = _readings(spark, d)
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "source string, weight double")
    rows = stored(rows, "readings")
    voted = stored(align.ensemble(rows, cells, weights), "voted")
    q = align.table_quality(voted, ["doc_id", "table_idx"])
    routed = route.ensemble_route(q.withColumn("critical", F.lit(False)), ["doc_id"], 0.95)
    groups = align.vote_groups(align.row_groups(rows, weights), weights).groupBy("doc_id").agg(F.bool_or("is_subtotal").alias("subtotal"))
    worst = F.when(F.col("flag") == "red", 2).when(F.col("flag") == "yellow", 1).otherwise(0)
    return q.select("doc_id", F.round("q_table", 4).alias("q_table"), worst.cast("int").alias("worst"), "cells").join(groups, "doc_id").join(routed.select("doc_id", "accepted"), "doc_id")


@query("""with n as (select distinct p_brand brand, p_name p from part), c as (select brand, p || case when length(p) % 3 = 0 then '' else 's' end t, p, length(p) k from n),
v as (select brand, p, p || 's' a, p b, case when k % 3 = 0 then 2 else 1 end nb, k % 3 = 0 same, p in ('red ring', 'big bolt') known from c)
select brand, p as label, case when known then b when same then b else a end term, true as conflict, case when same then 'red' else 'red' end flag from v""")
def label_votes(spark: SparkSession, d: str) -> DataFrame:
    """Labels of row groups voted by frequency and confidence, words of a lexicon first; red conflicts settled by an arbiter."""
    n = _t(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("label")).distinct()
    same = F.length("label") % 3 == 0
    votes = n.select("brand", "label", F.explode(F.array(F.struct(F.concat("label", F.lit("s")).alias("term"), F.lit(0.9).alias("confidence")), F.struct(F.col("label").alias("term"), F.lit(0.6).alias("confidence")), F.struct(F.when(same, F.col("label")).alias("term"), F.lit(0.6).alias("confidence")))).alias("v")).select("brand", "label", "v.*")
    lexicon = spark.createDataFrame([("red ring",), ("big bolt",)], "term string")
    found = align.vote_labels(votes, ["brand", "label"], 3, lexicon)
    return found.withColumn("flag", F.when(F.col("conflict"), "red").otherwise("green"))


@query("""with r as (select o_orderkey i, case when o_orderkey % 3 = 0 then 'red' else 'green' end flag, o_orderkey % 2 = 0 ruled, cast(o_totalprice as decimal(18,2))::double v from orders)
select i, case when flag = 'red' and ruled then 7.0 else v end "value", case when flag = 'red' and ruled then 'arbiter' else 'ensemble' end provenance, case when flag = 'red' and ruled then 'yellow' else flag end flag from r""")
def arbiter(spark: SparkSession, d: str) -> DataFrame:
    """Red conflicts settled by an arbiter's verdicts."""
    i = F.col("o_orderkey")
    voted = _t(spark, d, "orders").select(i.alias("i"), _money("o_totalprice").cast("double").alias("value"), F.lit("ensemble").alias("provenance"), F.when(i % 3 == 0, "red").otherwise("green").alias("flag"))
    verdicts = voted.filter("i % 2 = 0").select("i", F.lit(7.0).alias("verdict"))
    return align.arbitrate(voted, verdicts, ["i"])


@query("""with a as (select c_custkey i, c_nationkey k, row_number() over (partition by c_nationkey order by c_custkey) - 1 n from customer),
b as (select k, i, n, n % 4 = 0 dropped, n % 3 = 0 conflict from a), p as (select k, count(*) rows_, count(*) filter (not dropped) pairs, count(*) filter (not dropped and conflict) bad from b group by 1)
select cast(k as varchar) doc_id, rows_ as "rows", bad red, rows_ - pairs lone, round(pairs::double / rows_, 6) coverage, rows_ + 1 tables, bad conflicts, 'tier0,tier1' provenance from p""")
def tables_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of a nation's customers: rows aligned and merged, tables paired and supplied, conflicts and coverage."""
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    own = _t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), (F.row_number().over(w) - 1).cast("int").alias("row_idx"), "c_name")
    a = own.select("doc_id", "row_idx", F.col("c_name").alias("label"), F.col("c_name").alias("canonical"), F.lit("s").alias("section"))
    b = a.filter("row_idx % 4 <> 0")
    a, b = stored(a, "a"), stored(b, "b")
    aligned = stored(align.align_rows(a, b, ["doc_id"]), "aligned")
    named = b.withColumn("canonical", F.when(F.col("row_idx") % 3 == 0, F.concat("canonical", F.lit("!"))).otherwise(F.col("canonical")))
    rows = align.merge_rows(aligned, a, named, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("flag") == "red").alias("red"), F.count_if(F.col("b_idx").isNull()).alias("lone"))
    cells = named.select("doc_id", F.lit(0).alias("table_idx"), (F.col("row_idx") % 3 == 0).alias("conflict"))
    totals = route.conflict_totals(cells, aligned.withColumn("table_idx", F.lit(0)))
    first = a.select("doc_id", F.col("row_idx").alias("table_idx")).withColumn("x", F.lit(1))
    more = align.supplement(first, first.groupBy("doc_id").agg((F.max("table_idx") + 1).alias("table_idx"), F.lit(1).alias("x")).unionByName(first.limit(0)))
    paired = align.pair_tables(more, first).groupBy("doc_id").agg(F.count("*").alias("tables"))
    marked = align.with_provenance(a.select("doc_id"), "tier0").unionByName(align.with_provenance(b.select("doc_id"), "tier1")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("provenance")), ",").alias("provenance"))
    return rows.join(totals.withColumn("coverage", F.round("coverage", 6)), "doc_id").join(paired, "doc_id").join(marked, "doc_id").select("doc_id", "rows", "red", "lone", "coverage", "tables", "conflicts", "provenance")


# --- files ---------------------------------------------------------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""with t as (select p_name p, min(p_partkey) o from part group by 1) select 'terms' what, (select count(*) from t) n union all select 'of statement', (select count(*) from t where o % 2 = 0) union all select 'corrections', (select count(*) from t)
union all select 'accounts', 4 union all select 'parents', 3 union all select 'rules', 2 union all select 'rules of V1', 1 union all select 'variations', (select count(*) from events where event_type <> 'error') union all select 'vocabulary', (select count(distinct w) from (select upper(unnest(string_split(p, ' '))) w from t)) + 1
union all select 'prompt lines', (select count(*) from t) union all select 'keywords', (select count(*) from t where o % 3 = 0) * 2 union all select 'account of 41', 41 union all select 'unmatched', (select count(*) from customer) union all select 'fields', (select count(*) from t)
union all select 'results', (select count(distinct c_nationkey) from customer) union all select 'nested', (select count(*) from customer) union all select 'report checks', (select count(*) from customer) * 2 union all select 'overridden', (select count(*) from customer where c_custkey % 2 = 0)""")
def sources_json(spark: SparkSession, d: str) -> DataFrame:
    """Dictionaries, rules, logs, results and reports written as files and read back by their readers."""
    terms = _t(spark, d, "part").groupBy(F.col("p_name").alias("canonical")).agg(F.min("p_partkey").alias("o"))
    entry = F.struct("canonical", F.when(F.col("o") % 3 == 0, "s").otherwise("r").alias("section"), F.when(F.col("o") % 2 == 0, "bilan").otherwise("x").alias("statement"), F.array(F.concat("canonical", F.lit("z"))).alias("variations"), F.col("canonical").alias("field"))
    at = {n: _folder(spark, n) for n in ("terms", "corrections", "accounts", "rules", "log")}
    terms.groupBy().agg(F.collect_list(entry).alias("entries")).coalesce(1).write.json(at["terms"])
    wrong = terms.select(F.lit("NCT").alias("standard"), F.struct(F.concat("canonical", F.lit("q")).alias("key"), F.col("canonical").alias("value")).alias("e")).groupBy("standard").agg(F.map_from_entries(F.collect_list("e")).alias("pairs"))
    wrong.coalesce(1).write.json(at["corrections"])
    spark.createDataFrame([({"4": "Tiers", "41": "Clients", "411": "Clients ordinaires", "5": "Banque"},)], "accounts map<string,string>").coalesce(1).write.json(at["accounts"])
    spark.createDataFrame([([("R1", "V1", True, ["NCT"]), ("R2", "V2", True, ["NCT", "IFRS"]), ("R3", "V1", False, ["NCT"]), ("R4", "V1", True, ["IFRS"])],)], "rules array<struct<rule_id:string,tier:string,active:boolean,standards:array<string>>>").coalesce(1).write.json(at["rules"])
    events = _t(spark, d, "events")
    readers.append_log(events.filter("event_type = 'click'").select(F.col("event_type").alias("raw_text"), F.col("event_type").alias("matched_to")), at["log"])
    readers.append_log(events.filter("event_type not in ('click', 'error')").select(F.col("event_type").alias("raw_text"), F.col("event_type").alias("matched_to")), at["log"])
    events.filter("event_type = 'error'").select(F.lit("{broken")).write.mode("append").text(at["log"])
    found, fixed, tree, ruled = dictionary.terms(spark, at["terms"]), dictionary.corrections(spark, at["corrections"], "NCT"), dictionary.accounts(spark, at["accounts"]), readers.rules(spark, at["rules"], "NCT")
    sections = spark.createDataFrame([("s", "actif")], "section string, side string")
    coded = spark.createDataFrame([("41",)], "account_code string").join(tree.withColumnsRenamed({"code": "account_code", "label": "canonical"}).withColumn("ord", F.lit(0)), "account_code")
    looked = match.lookup_account(coded.select("account_code"), coded)
    prompt = dictionary.prompt_vocabulary(found).select(F.explode(F.split("prompt", "\n")).alias("line")).filter(F.col("line").startswith("- "))
    customers = _t(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("name").alias("col_name"), F.col("c_name").alias("raw_value"), F.lit("a").alias("source"), F.lit(0).alias("table_idx"))
    fields = match.validation_field(found.select(F.col("canonical").alias("label")), match.term_index(found), found.select("canonical", F.col("field").alias("validation_field"))).filter("validation_field is not null")
    check = F.array(F.struct(F.lit("x").alias("name"), F.lit(True).alias("passed"), F.lit("ERROR").alias("severity")), F.struct(F.lit("y").alias("name"), F.lit(False).alias("passed"), F.lit("CRITICAL").alias("severity")))
    reports = readers.report_of_json(_t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.to_json(F.struct(check.alias("checks"))).alias("report")))
    checks = _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("y").alias("check_name"), F.lit(False).alias("passed"))
    judged = readers.validated_checks(checks, checks.filter("doc_id % 2 = 0").withColumn("passed", F.lit(True)))
    count = lambda name, df, n=None: df.agg((F.count("*") if n is None else n).cast("long").alias("n")).select(F.lit(name).alias("what"), "n")
    parts = [
        count("terms", found), count("of statement", dictionary.of_statement(found, "bilan")), count("corrections", fixed), count("accounts", tree), count("parents", tree.filter("parent is not null"), F.count("*") + 1), count("rules", ruled), count("rules of V1", readers.rules_of_tier(ruled, "V1")),
        count("variations", readers.variation_log(spark, at["log"])), count("vocabulary", readers.vocabulary(fixed, ["zzz"])), count("prompt lines", prompt), count("keywords", dictionary.side_keywords(found, sections)), count("account of 41", looked.filter("canonical = 'Clients'"), F.max("account_code")),
        count("unmatched", dictionary.unmatched_table(customers)), count("fields", fields), count("results", readers.result_json(customers, ["doc_id"])), count("nested", readers.nested_rows(customers, ["doc_id"])), count("report checks", reports, F.sum("total")), count("overridden", judged.filter("passed")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_DOCX = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


@F.pandas_udf(T.BinaryType())
def _docx(names: pd.Series, amounts: pd.Series) -> pd.Series:
    """Word-processor files with a paragraph, a table of four rows, one of two, and an image."""
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    out = []
    for name, amount in zip(names, amounts):
        body = p(f"Report of {name}, which is long enough to be no scan at all") + "<w:tbl>" + row("Label", "Net") + row("Stocks", amount) + row("Clients", "5") + row("Total", "x") + "</w:tbl><w:tbl>" + row("a", "b") + row("c", "d") + "</w:tbl>"
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("word/document.xml", _DOCX.format(body))
            z.writestr("word/media/image1.png", b"png")
        out.append(data.getvalue())
    return pd.Series(out)


@query("""with c as (select c_name n, printf('%.2f', c_acctbal) v, c_custkey k from customer), f as (select *, k % 5 = 0 broken from c)
select n || '.docx' path, 6::bigint cells, v amount, 'Report of ' || n || ', which is long enough to be no scan at all' as text, false scanned, round(case when k % 3 = 0 then 0.9 else 0.5 end::double, 2) ocr, case when k % 3 = 0 then 'EXCELLENT' else 'FAIR' end low_grade, 0.21::double top2, 2::bigint columns from f where not broken""")
def docx_scan(spark: SparkSession, d: str) -> DataFrame:
    """Word-processor files, some broken, to cells and text; the better of two readings, grades, boxes."""
    files = _t(spark, d, "customer").select(F.concat("c_name", F.lit(".docx")).alias("path"), F.lit("docx").alias("kind"), _docx(F.col("c_name"), F.format_string("%.2f", "c_acctbal")).alias("content"), F.col("c_custkey").alias("k"))
    files = stored(files.withColumn("content", F.when(F.col("k") % 5 == 0, F.lit("junk").cast("binary")).otherwise(F.col("content"))), "files")
    cells = stored(documents.scan_cells(files), "cells")
    texts = documents.document_text(documents.scan_text(files))
    garbled = filters.garbled_tables(cells.withColumnRenamed("path", "doc_id")).withColumnRenamed("doc_id", "path")
    lone = cells.filter("col_idx = 0")
    best = documents.better_strategy(lone, cells, filters.garbled_tables(lone.withColumnRenamed("path", "doc_id")).withColumnRenamed("doc_id", "path"), ["path", "source", "table_idx"])
    sized = filters.drop_small_tables(best.withColumnRenamed("path", "doc_id")).groupBy(F.col("doc_id").alias("path")).agg(F.count("*").alias("cells"), F.max(F.when((F.col("row_idx") == 0) & (F.col("col_idx") == 1), F.col("raw_value"))).alias("amount"), F.countDistinct("col_idx").alias("columns"))
    score = F.when(F.col("k") % 3 == 0, 0.9).otherwise(0.5)
    grades = documents.reading_grades(files.select("path", score.alias("ocr_score"), F.lit(0.9).alias("layout_score")))
    boxes = documents.synthetic_boxes(cells.filter("col_idx = 0"), ["path"]).filter("row_idx = 2").select("path", F.round("top", 2).alias("top2"))
    whole = sized.join(garbled.filter("not garbled").select("path"), "path")
    return whole.join(texts, "path").join(grades.select("path", "ocr", "low_grade"), "path").join(boxes, "path").select("path", "cells", "amount", "text", "scanned", "ocr", "low_grade", "top2", "columns")


# --- streams -------------------------------------------------------------------------------------------------------------

@query("""with e as (select distinct event_id, user_id, ts, event_type from events), w as (select time_bucket(interval '1 hour', ts) t, event_type, count(*) n from e group by 1, 2)
select event_type, count(*) windows, sum(n)::bigint n, max(n) most from w where t < (select max(time_bucket(interval '1 hour', ts)) from e) - interval '1 hour' group by 1""")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events as a file stream, every row twice: duplicates out within the watermark, hourly counts, run to the end."""
    at, out, mark = (_folder(spark, n) for n in ("stream", "windows", "progress"))
    events = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    events.unionByName(events).repartition(3, "event_id").write.parquet(at)
    stream = streams.read_events(spark, at, events.schema, lateness="1 second")
    counts = streams.window_counts(streams.deduplicated(stream, ["event_id"]), "event_type", "1 hour")
    streams.run_to_end(counts, out, mark)
    done = spark.read.parquet(out)
    last = events.agg(F.max(F.date_trunc("hour", F.col("ts"))).alias("m"))
    closed = done.join(last).filter(F.col("start").cast("timestamp_ntz") < F.col("m") - F.expr("interval 1 hour"))
    return closed.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"), F.max("n").alias("most"))


@query("""with o as (select user_id, ts, lag(ts) over (partition by user_id order by ts) p from events), s as (select user_id, ts, sum(case when p is null or ts >= p + interval '30 minutes' then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) k from o),
g as (select user_id, k, count(*) n, min(ts) a, max(ts) b from s group by 1, 2) select user_id, count(*) sessions, max(n) most, sum(epoch_us(b) - epoch_us(a))::bigint micros from g group by 1""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by gaps of half an hour."""
    found = streams.sessions(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id")
    span = F.unix_micros("end") - F.unix_micros("start") - 1_800_000_000
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("most"), F.sum(span).alias("micros"))


@query("""select event_type, count(*) n, min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00') first from events group by 1""")
def stream_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream whose micro-batches are handed to a sink each; instants as ISO text."""
    at, out, mark = (_folder(spark, n) for n in ("stream", "sink", "progress"))
    events = _t(spark, d, "events").select("event_id", "ts", "event_type")
    events.repartition(2, "event_id").write.parquet(at)
    stream = streams.read_events(spark, at, events.schema)
    streams.fan_out(stream, mark, lambda batch, i: batch.write.mode("append").parquet(out))
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"), F.min(iso_utc(F.col("ts"))).alias("first"))


@query("""with p as (select p_brand d, p_partkey i, case when p_size % 2 = 0 then upper(p_name) else p_name end l, case when p_brand < 'Brand#3' then p_size::double end z, p_partkey % 17 = 0 b, p_size from part), m as (select d, list_sort(list(z)) s from p where z is not null group by d)
select d doc_id, i row_idx, case when s is not null then b or z >= 1.15::double * s[len(s) // 2 + 1] else p_size % 2 = 0 and length(l) between 3 and 80 end is_heading from p left join m using (d)""")
def headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings by font size against the table's middle or by bold type, where no fonts are known by capitals."""
    rows = _t(spark, d, "part").select(
        F.col("p_brand").alias("doc_id"), F.lit("a").alias("source"), F.lit(0).alias("table_idx"), F.col("p_partkey").alias("row_idx"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("label"),
        F.when(F.col("p_brand") < "Brand#3", F.col("p_size").cast("double")).alias("font_size"), (F.col("p_partkey") % 17 == 0).alias("bold"),
    )
    return ordered.heading_rows(rows).select("doc_id", "row_idx", "is_heading")


@query("""with c as (select c_custkey k, c_nationkey n from customer), t as (select n, count(*) m from c group by 1)
select cast(k as varchar) doc_id, case when k % 3 = 0 then 'ocr' else 'native' end as text, cast(case when k % 2 = 0 then 3 else 2 end as bigint) tables, ['a', 'b', 'c'] columns, k % 5 <> 0 noisy,
 case when k % 4 = 0 then 'Needs Correction' when k % 7 >= 5 then 'Excellent' when k % 7 >= 3 then 'Good' else 'Acceptable' end quality from c""")
def reading_parts(spark: SparkSession, d: str) -> DataFrame:
    """The first tier's tables and texts, united columns, columns in which dots are noise, and a quality to suggest."""
    i = F.col("c_custkey")
    base = _t(spark, d, "customer").select(i.cast("string").alias("doc_id"), i.alias("k"))
    k = F.col("k")
    native = base.select("doc_id", F.explode(F.when(k % 2 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("table_idx"))
    optical = base.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("table_idx"))
    cells, texts = route.first_tier(native, optical, base.select("doc_id", F.when(k % 3 == 0, " ").otherwise("native").alias("text")), base.select("doc_id", F.lit("ocr").alias("text")))
    raw = base.select("doc_id", F.lit("a").alias("source"), F.lit(0).alias("table_idx"), F.lit(1).alias("col_idx"), F.explode(F.when(k % 5 == 0, F.array(F.lit("12.345"), F.lit("99.999"), F.lit("1234"))).otherwise(F.array(F.lit("12345"), F.lit("99.999"), F.lit("1234")))).alias("raw_value"))
    noisy = columns.dots_are_noise(raw).select("doc_id", "noisy")
    united = base.select("doc_id", align.union_columns(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("columns"), rules.suggested_quality(k % 4 != 0, F.when(k % 7 >= 5, 0.9).when(k % 7 >= 3, 0.8).otherwise(0.1)).alias("quality"))
    return texts.join(cells.groupBy("doc_id").agg(F.count("*").alias("tables")), "doc_id").join(united, "doc_id").join(noisy, "doc_id")
