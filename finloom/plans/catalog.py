"""Queries over the driver tables, each with its DuckDB twin where SQL can express it.

The tables hold no statements, so every operator of the engine runs on an analogue: orders and their lines stand for
totals and components, customers and suppliers for the two sides of a balance, events for logs and jobs. Amounts are
summed as decimals and published scores rounded, so that the order of additions cannot show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, quality, similarity, text
from ..functions.columns import spread
from ..operators import align, filters, match, ordered, repair, route, rules, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _money(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


# --- quality of texts -------------------------------------------------------------------------------------------

_TERMS = ", ".join(f"'{t}'" for t in quality.TERMS)
_SCORES = f"""
with w as (select doc_id, text, lower(text) low, length(text) n, regexp_extract_all(lower(text), '{quality.LETTERS}') words from documents),
f as (select doc_id, n, low, case when n = 0 then 0.0::double when len(words) < 5 then 0.5::double else least(1.0::double, 5.0::double * len(list_filter(words, lambda x: x in ({_TERMS}))) / len(words)) end lexical,
 case when length(replace(replace(text, ' ', ''), chr(10), '')) = 0 then 0.0::double else least(1.0::double, 2.5::double * len(regexp_extract_all(text, '[0-9]')) / length(replace(replace(text, ' ', ''), chr(10), ''))) end num from w),
c as (select doc_id, n, ch, count(*) k from (select doc_id, n, unnest(string_split(low, '')) ch from f) where ch <> '' group by doc_id, n, ch),
h as (select doc_id, -sum((k / n::double) * log2(k / n::double)) bits from c group by doc_id),
e as (select f.doc_id, lexical, num, coalesce(bits, 0.0) bits, case when n < 10 then 0.5::double when bits < 3.5 then bits / 3.5 when bits > 5.5 then 5.5 / bits else 1.0::double end ent from f left join h using (doc_id)),
q as (select doc_id, round(lexical, 6) lexical, round(num, 6) num, round(bits, 6) bits, round(0.3::double * lexical + 0.4::double * num + 0.3::double * ent, 6) heuristic from e)
"""


def _quality_rows(docs: DataFrame) -> DataFrame:
    base = spread(docs).withColumns({"n": F.length("text"), "lexical": quality.lexical_density(F.col("text")), "num": quality.numeric_density(F.col("text"))})
    bits = base.withColumn("bits", quality.char_entropy(F.col("text")))
    ent = quality.entropy_band(F.col("bits"), F.col("n"))
    return bits.withColumn("heuristic", F.round(quality.heuristic(F.col("lexical"), F.col("num"), ent), 6))


@query(_SCORES + """select doc_id, lexical, num, bits, heuristic, case when heuristic >= 0.85 then 'EXCELLENT' when heuristic >= 0.65 then 'GOOD' when heuristic >= 0.40 then 'FAIR' else 'POOR' end grade,
round(greatest(0.0, 0.4 * (case when heuristic >= 0.85 then 1.0 when heuristic >= 0.65 then 0.8 when heuristic >= 0.40 then 0.55 else 0.25 end)::double + 0.3 * heuristic + 0.15), 6) qcs from q""")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and numeric density, entropy, heuristic score, grade from the heuristic (no engine grades here), composite."""
    rows = _quality_rows(_t(spark, d, "documents").select("doc_id", "text"))
    grade = numbers.score_to_grade(F.col("heuristic"))
    qcs = quality.composite(numbers.grade_to_score(grade), F.col("heuristic"), F.lit(0.5), F.lit(0.0), F.lit("FAIR"))
    return rows.select("doc_id", F.round("lexical", 6).alias("lexical"), F.round("num", 6).alias("num"), F.round("bits", 6).alias("bits"), "heuristic", grade.alias("grade"), F.round(qcs, 6).alias("qcs"))


@query(_SCORES + """select case when heuristic >= 0.85 then 'EXCELLENT' when heuristic >= 0.65 then 'GOOD' when heuristic >= 0.40 then 'FAIR' else 'POOR' end grade,
cast(quality as integer) quality, count(*) n, round(cast(sum(cast(heuristic as decimal(18,6))) as double) / count(*), 4) avg_heuristic from q join labels using (doc_id) group by 1, 2""")
def quality_vs_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "labels").select("doc_id", "quality")
    rows = _quality_rows(_t(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id"))
    mean = F.sum(F.col("heuristic").cast("decimal(18,6)")).cast("double") / F.count("*")
    return rows.groupBy(numbers.score_to_grade(F.col("heuristic")).alias("grade"), F.col("quality").cast("int").alias("quality")).agg(F.count("*").alias("n"), F.round(mean, 4).alias("avg_heuristic"))


# --- repair and normal forms ------------------------------------------------------------------------------------

_GLYPHS = [("O", "0"), ("o", "0"), ("l", "1"), ("I", "1"), ("S", "5"), ("B", "8")]
_REPAIRED = "regexp_replace(text, '(^|\\s)[=:_~](\\d)', '\\1-\\2', 'g')"
for _g, _d in _GLYPHS:
    _REPAIRED = f"regexp_replace({_REPAIRED}, '(\\d){_g}(\\d)', '\\1{_d}\\2', 'g')"


@query(f"select doc_id, md5({_REPAIRED}) repaired from documents")
def ocr_repair(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(text.numeric_format_repair(F.col("text"))).alias("repaired"))


def _rewritten_sql() -> str:
    """CTEs that count and rewrite texts step by step as the engine does."""
    steps = [("terms", wrong, right, "gi") for wrong, right in repair.FALLBACK_TERMS] + [(c, p.replace("(?m)", ""), r.replace("${1}", "\\1").replace("$1", "\\1").replace("$2", "\\2"), "gm" if "(?m)" in p else "g") for c, p, r in repair.REWRITES]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sql, last = "t0 as (select doc_id, length(text) n, text t, 0 terms, 0 camel, 0 space, 0 sign, 0 glyph from documents)", "t0"
    for i, (category, pattern, right, flags) in enumerate(steps, 1):
        right = right.replace("$1", "\\1").replace("$2", "\\2")
        counts = ", ".join(f"{c} + len(regexp_extract_all(t, {quoted(pattern)}, 0, '{flags.replace('g', '') or 'c'}')) {c}" if c == category else c for c in ("terms", "camel", "space", "sign", "glyph"))
        sql += f",\n{'t%d' % i} as (select doc_id, n, regexp_replace(t, {quoted(pattern)}, {quoted(right)}, '{flags}') t, {counts} from {last})"
        last = f"t{i}"
    return "with " + sql + f", c as (select *, terms + camel + space + sign + glyph total from {last})"


@query(_rewritten_sql() + """ select doc_id, terms::bigint n_terms, camel::bigint n_camel, space::bigint n_space, sign::bigint n_sign, glyph::bigint n_glyph, total::bigint n_corrections, md5(t) rewritten,
 round(case when total = 0 then 0.0 else least(0.08, total / greatest(n / 100.0::double, 10.0) * 0.01) end::double, 6) penalty from c""")
def correction_stats(spark: SparkSession, d: str) -> DataFrame:
    """Texts rewritten step by step, each step counted on what the one before left; the penalty for it."""
    docs = spread(_t(spark, d, "documents").select("doc_id", "text")).withColumn("n", F.length("text"))
    found = repair.correction_counts(docs)
    return found.select("doc_id", "n_terms", "n_camel", "n_space", "n_sign", "n_glyph", "n_corrections", F.md5("text").alias("rewritten"), F.round(quality.correction_penalty(F.col("n_corrections"), F.col("n")), 6).alias("penalty"))


@query("select p_name label, trim(regexp_replace(strip_accents(lower(p_name)), '[''’‘`&\\s]+', ' ', 'g')) form, count(*) n from part group by 1, 2")
def normalize_labels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("n")).select("label", text.normalize(F.col("label")).alias("form"), "n")


_FRENCH = "replace(printf('%.2f', l_extendedprice), '.', ',')"


@query(f"""with v as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice x, case l_linenumber % 4 when 0 then '(' || {_FRENCH} || ')' when 1 then {_FRENCH} || ' DT' when 2 then '–' else 'n.d.' end raw, l_linenumber % 4 k from lineitem)
select raw, cast(case k when 0 then -cast(round(x, 2) as decimal(18,2)) when 1 then cast(round(x, 2) as decimal(18,2)) when 2 then 0 end as double) as parsed, count(*) n from v group by 1, 2""")
def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    """French forms of line prices, read back."""
    k, french = F.col("l_linenumber") % 4, F.translate(F.format_string("%.2f", "l_extendedprice"), ".", ",")
    raw = F.when(k == 0, F.concat(F.lit("("), french, F.lit(")"))).when(k == 1, F.concat(french, F.lit(" DT"))).when(k == 2, "–").otherwise("n.d.")
    counts = _t(spark, d, "lineitem").groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return counts.select("raw", numbers.parse_french(F.col("raw")).cast("double").alias("parsed"), "n")


@query("""with c as (select unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) col, unnest([cast(o_orderkey as varchar), o_orderstatus, cast(o_totalprice as varchar), o_orderpriority]) v from orders)
select col, round(avg(case when regexp_matches(replace(v, ' ', ''), '^-?[0-9]+(\\.[0-9]*)?$') then 1.0 else 0.0 end), 6) ratio from c group by col having ratio > 0.5""")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of orders of which most cells read as numbers; priorities such as 5-LOW do not."""
    names = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    orders = _t(spark, d, "orders")
    cells = orders.select(F.explode(F.array(*[F.struct(F.lit(i).alias("col_idx"), F.col(n).cast("string").alias("raw_value")) for i, n in enumerate(names)])).alias("c")).select(F.lit("orders").alias("doc_id"), F.lit("a").alias("source"), F.lit(0).alias("table_idx"), "c.*")
    found = filters.numeric_columns(cells)
    return found.select(F.get(F.array(*map(F.lit, names)), F.col("col_idx")).alias("col"), F.round("ratio", 6).alias("ratio"))


# --- matching ---------------------------------------------------------------------------------------------------

_DIM = [("red widget", "tools", 0), ("small ring", "jewels", 1), ("blue gear", "tools", 2), ("Grand Bolt", "metal", 3), ("red ring", "jewels", 4)]
_VALUES = ", ".join(f"('{t}', '{c}', {o})" for t, c, o in _DIM)


@query(f"""with dim as (select * from (values {_VALUES}) v(term, category, ord))
select p_name label, case when term is null then 'none' else 'exact' end match_type, category, count(*) n from part left join dim on lower(trim(p_name)) = lower(term) group by 1, 2, 3""")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([(t, c, "x", [], o) for t, c, o in _DIM], "canonical string, section string, statement string, variations array<string>, ord int")
    labels = _t(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("n"))
    found = match.exact_lookup(labels, match.term_index(terms))
    return found.select("label", F.coalesce("match_type", F.lit("none")).alias("match_type"), F.col("section").alias("category"), "n")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def lookup_anti(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_VOCABULARY = ["widget", "gadget", "ring", "bolt", "gear", "screw", "plate"]
_WORDS = ", ".join(f"('{w}', {i})" for i, w in enumerate(_VOCABULARY))


@query(f"""with v as (select * from (values {_WORDS}) v(m, ord)), w as (select distinct unnest(string_split(p_name, ' ')) word from part),
s as (select word || 'x' word from w union select word from w union select substr(word, 2) from w where length(word) > 2)
select word, m "match", cast(levenshtein(word, m) as integer) distance from s, v where abs(length(word) - length(m)) <= 2 and levenshtein(word, m) <= 2
qualify row_number() over (partition by word order by levenshtein(word, m), length(m), ord) = 1""")
def edit_distance_top1(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt words of part names against a vocabulary."""
    words = _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    spelt = words.unionByName(words.select(F.concat("word", F.lit("x")).alias("word"))).unionByName(words.filter(F.length("word") > 2).select(F.expr("substring(word, 2)").alias("word"))).distinct()
    vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(_VOCABULARY)], "word string, ord int")
    return match.nearest_word(spelt, vocabulary)


def indel_sql(a: str, b: str) -> str:
    """SQL: 100 x twice the longest common subsequence by the length of both, by a row of the table per character."""
    row = f"list_transform(range(0, length({b}) + 1), lambda z: 0)"
    step = f"list_prepend(0, list_transform(range(1, length({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k + 1], acc[k] + case when unicode(substr({b}, k, 1)) = x[1] then 1 else 0 end)))))"
    lcs = f"list_reduce(list_prepend({row}, list_transform(range(1, length({a}) + 1), lambda i: [unicode(substr({a}, i, 1))])), lambda acc, x: {step})[length({b}) + 1]"
    return f"(case when length({a}) + length({b}) = 0 then 100.0 when length({a}) = 0 or length({b}) = 0 then 0.0 else 200.0 * {lcs} / (length({a}) + length({b})) end)::double"


def _partial_sql(a: str, b: str) -> str:
    """SQL: the best ratio of the shorter string with a window of the longer one, cut off at the ends."""
    window = f"substr({b}, greatest(i, 0) + 1, i + length({a}) - greatest(i, 0))"
    best = f"list_max(list_transform(range(1 - length({a}), length({b})), lambda i: {indel_sql(a, window)}))"
    return best


def _cascade_sql(labels: str, entries: str, more: str = "") -> str:
    """SQL of the cascade: labels (label, form, scope), entries (scope, canonical, form, kind, ord), then CTEs ap (label,
    override) and cu (label). Forms are lower-case words of letters."""
    sorted_ = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
    return f"""with lb as ({labels}), en as ({entries}), {more or "ap as (select null::varchar label, null::varchar override where false), cu as (select null::varchar label where false)"},
ix as (select scope, form, min((kind, ord, canonical)) e from en group by 1, 2), fd as (select lb.*, e, override, cu.label is not null custom from lb left join ix using (scope, form) left join ap on ap.label = lb.label left join cu on cu.label = lb.label),
op as (select distinct scope, form from fd where e is null and override is null and not custom and form <> ''),
ca as (select scope, form cand, arg_max(canonical, ord) term, min(ord) ord from en where kind = 0 group by 1, 2),
sc as (select scope, form, term, ord, {indel_sql('a', 'b')} s from (select scope, form, term, ord, {sorted_('form')} a, {sorted_('cand')} b from op join ca using (scope))),
bs as (select scope, form, max(s) s, arg_max(term, (s, -ord)) term from sc group by 1, 2),
pw as (select scope, form, ca.term, ca.ord, case when length(form) <= length(cand) then form else cand end a, case when length(form) <= length(cand) then cand else form end b from op join ca using (scope) left join bs b2 using (scope, form) where coalesce(b2.s, 0) < 85),
pa as (select scope, form, max(p) p, arg_max(term, (p, -ord)) term from (select scope, form, term, ord, {_partial_sql('a', 'b')} p from pw) group by 1, 2),
cascade as (select fd.*, case when custom or form = '' then null when e is not null then e[3] when override is not null then override when bs.s >= 85 then bs.term when pa.p >= 85 then pa.term end found,
 case when form = '' then 'unrecognized' when custom then 'custom' when e is not null and e[1] = 0 then 'exact' when e is not null or override is not null then 'resolved' when bs.s >= 85 or pa.p >= 85 then 'fuzzy' else 'custom' end match_type,
 round((case when form = '' or custom then 0 when e is not null and e[1] = 0 then 1 when e is not null or override is not null then 0.98 when bs.s >= 85 then bs.s / 100 when pa.p >= 85 then pa.p / 100 when bs.s >= 75 then bs.s / 100 else 0 end)::double, 6) match_confidence
 from fd left join bs using (scope, form) left join pa using (scope, form))"""


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c, "x", [t + "s"], o) for t, c, o in _DIM], "canonical string, section string, statement string, variations array<string>, ord int")


_ALL_TERMS = " union all ".join(f"select 'a' scope, '{t}' canonical, lower('{t}{v}') form, {k} kind, {o} ord" for t, _, o in _DIM for k, v in ((0, ""), (1, "s")))
_SCOPED_TERMS = _ALL_TERMS + " union all " + " union all ".join(f"select 's:{c}', '{t}', lower('{t}{v}'), {k}, {o}" for t, c, o in _DIM for k, v in ((0, ""), (1, "s"))) + " union all " + _ALL_TERMS.replace("'a'", "'t:x'")
_LOST = "select distinct left(p_name, 2) || '?' || substr(p_name, 4) label from part"
_RANK = "translate({}, 'eaioucny', '01234567')"


@query(_cascade_sql(f"select distinct replace(label, '?', '') as label, replace(label, '?', '') form, 'a' scope from ({_LOST})", _ALL_TERMS) + f""",
l as ({_LOST}), fl as (select label, replace(label, '?', c) form from l, (select unnest(string_split('eaioucny', '')) c)),
ht as (select label, e[3] canonical, e[2] ord, min({_RANK.format("form")}) rank from fl join ix using (form) where scope = 'a' group by 1, 2, 3),
hr as (select *, {indel_sql("low", "bare")} ratio from (select *, lower(canonical) low, replace(label, '?', '') bare from ht)),
hb as (select label, count(*) hits, arg_min(canonical, (rank, ord)) f, arg_min(canonical, (-ratio, rank, ord)) c from hr group by 1)
select l.label, cast(coalesce(hits, case when found is not null and match_confidence >= 0.8 then 1 else 0 end) as integer) hits,
case when hits between 2 and 3 then c when hits is not null then f when found is not null and match_confidence >= 0.8 then found else l.label end best,
round((case when hits = 1 then 0.99 when hits <= 3 then 0.8 when hits > 3 then 0.5 when found is not null and match_confidence >= 0.8 then least(0.8, match_confidence) else 0.5 end)::double, 6) confidence
from l left join hb using (label) left join cascade on cascade.label = replace(l.label, '?', '')""")
def wildcard_join(spark: SparkSession, d: str) -> DataFrame:
    """Part names with a lost third letter against the terms: fillings looked up, else the rest matched by similarity."""
    names = _t(spark, d, "part").select("p_name").distinct()
    labels = names.select(F.concat(F.expr("substring(p_name, 1, 2)"), F.lit("?"), F.expr("substring(p_name, 4)")).alias("label")).distinct()
    return match.wildcard_join(labels, _terms(spark)).withColumn("confidence", F.round("confidence", 6))


@query(_cascade_sql("select distinct p_name as label, lower(p_name) form, 'a' scope from part", _ALL_TERMS) + " select label, found canonical, match_type, match_confidence from cascade")
def fuzzy_match_indel(spark: SparkSession, d: str) -> DataFrame:
    """The full cascade over part names."""
    labels = _t(spark, d, "part").select(F.col("p_name").alias("label")).distinct()
    found = match.fuzzy_match(labels, _terms(spark))
    return found.select("label", "canonical", "match_type", F.round("match_confidence", 6).alias("match_confidence"))


@query(_cascade_sql("select distinct p_name as label, lower(p_name) form, case p_size % 3 when 0 then 's:tools' when 1 then 't:x' else 'a' end scope from part", _SCOPED_TERMS,
 "ap as (select 'old plate' as label, 'Grand Bolt' override union all select 'new screw', 'small ring'), cu as (select 'big plate' as label union all select 'big ring')")
 + " select label, case scope when 's:tools' then 'tools' else 'nowhere' end section, case scope when 't:x' then 'x' else 'y' end statement, found canonical, match_type, match_confidence from cascade")
def fuzzy_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The cascade within section, statement or everything, with confirmed customs and approved meanings from their log."""
    k = F.col("p_size") % 3
    labels = _t(spark, d, "part").select(F.col("p_name").alias("label"), F.when(k == 0, "tools").otherwise("nowhere").alias("section"), F.when(k == 1, "x").otherwise("y").alias("statement")).distinct()
    log = spark.createDataFrame(
        [("old plate", "blue gear", "fuzzy", True, 1), ("old plate", "Grand Bolt", "fuzzy", True, 2), ("new screw", "small ring", "fuzzy", True, 1), ("new plate", "red ring", "fuzzy", False, 1), ("old ring", "no term", "fuzzy", True, 1), ("big plate", None, "confirmed_custom", False, 1), ("big ring", None, "confirmed_custom", False, 3)],
        "raw_text string, matched_to string, match_type string, approved boolean, ts int",
    )
    found = match.fuzzy_match(labels, _terms(spark), store.approved(log), store.confirmed_customs(log))
    return found.select("label", "section", "statement", "canonical", "match_type", F.round("match_confidence", 6).alias("match_confidence"))


@query("""with k as (select * from (values ('jewel', 'ring', 0), ('tool', 'widget', 0), ('tool', 'gear', 1)) v(figure, kw, prio))
select p_brand brand, figure, arg_min(p_retailprice, (prio, p_partkey)) "value" from part join k on contains(p_name, kw) group by 1, 2""")
def keyword_priority(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("jewel", "ring", 0), ("tool", "widget", 0), ("tool", "gear", 1)], "figure string, keyword string, priority int")
    rows = _t(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("value"))
    return match.keyword_values(rows, words, ["brand"])


_BOOST = {"bilan": [[" les ", " des "]], "compte_resultat": [[" the "]], "flux_tresorerie": [[" und ", " der "]]}


@query("""with s as (select doc_id, lower(l) t, case when contains(l, 'e') then lang else null end v from (select doc_id, lang, unnest(string_split(text, chr(10))) l from documents)),
v as (select doc_id, count(*) filter (v = 'fr') + 3 * max(cast(regexp_matches(t, ' les | des ') as int)) a, count(*) filter (v = 'en') + 3 * max(cast(contains(t, ' the ') as int)) b, count(*) filter (v = 'de') + 3 * max(cast(regexp_matches(t, ' und | der ') as int)) c from s group by 1),
w as (select *, greatest(a, b, c)::double m, (a + b + c)::double n from v),
x as (select doc_id, case when n = 0 then 'unknown' when a = m then 'bilan' when b = m then 'compte_resultat' else 'flux_tresorerie' end as label, round((case when n = 0 then 0 else least(1.0::double, 1.2::double * m / n) end)::double, 6) confidence,
 case when m < 2 then 'unknown' when a = m then 'bilan' when b = m then 'compte_resultat' else 'flux_tresorerie' end strict from w)
select doc_id, label, confidence, strict, case when label = 'unknown' or confidence < 0.7 then 'REJECTED' else 'ACCEPTED' end status from x""")
def doc_classify(spark: SparkSession, d: str) -> DataFrame:
    """Lines vote and boost by the engine's classifier, languages in place of statements; then the strict gate."""
    lines = spread(_t(spark, d, "documents").select("doc_id", "text", "lang")).select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("label"))
    named = F.when(F.col("lang") == "fr", "bilan").when(F.col("lang") == "en", "compte_resultat").when(F.col("lang") == "de", "flux_tresorerie")
    rows = lines.select("doc_id", "label", F.when(F.contains("label", F.lit("e")), named).alias("statement"))
    found = match.classify_statements(rows, ["doc_id"], boosters=_BOOST).withColumn("confidence", F.round("confidence", 6))
    category = F.when(F.col("label") == "unknown", "Autre").otherwise(F.col("label"))
    return found.withColumn("status", filters.gate_status(category, F.col("confidence")))


# --- order --------------------------------------------------------------------------------------------------------

@query("""select event_id, last_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) section from events""")
def section_fill_down(spark: SparkSession, d: str) -> DataFrame:
    """Each event under its user's last error, as rows stand under their heading."""
    rows = _t(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", F.col("event_id")).alias("section"))
    return ordered.fill_down(rows, "section", ["user_id"], ["ts", "event_id"]).select("event_id", "section")


@query("""with l as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) expected, count(*) children from lineitem group by 1)
select o_orderkey, cast(expected as double) expected, cast(round(o_totalprice, 2) as double) actual, abs(cast(o_totalprice as decimal(18,2)) - expected) <= 1 as "valid" from orders left join l on l_orderkey = o_orderkey""")
def footing_check(spark: SparkSession, d: str) -> DataFrame:
    """Order totals against the sum of their lines, as subtotals against their children."""
    total = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(True).alias("is_subtotal"), F.lit(1).alias("row_idx"), _money("o_totalprice").alias("value"))
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(False).alias("is_subtotal"), F.lit(0).alias("row_idx"), _money("l_extendedprice").alias("value"))
    rows = total.unionByName(lines).withColumn("section", F.lit(None).cast("string"))
    found = ordered.footing(rows, ["doc_id"])
    return found.select(F.col("doc_id").alias("o_orderkey"), F.col("expected").cast("double").alias("expected"), F.col("actual").cast("double").alias("actual"), "valid")


@query("""with e as (select user_id, event_id, event_type = 'error' as t, cast(value as decimal(18,2)) v, row_number() over (partition by user_id order by ts, event_id) - 1 i from events),
g as (select *, coalesce(sum(t::int) over (partition by user_id order by i rows between unbounded preceding and 1 preceding), 0) g from e),
j as (select a.user_id, a.i, a.event_id, a.v expected, sum(b.v) actual, count(*) n from g a join g b on a.user_id = b.user_id and a.g = b.g and not b.t and b.i < a.i and b.i > greatest(0, a.i - 20) where a.t and a.v <> 0 group by all)
select user_id, cast(i as integer) row_idx, expected::double expected, actual::double actual, n components, abs(expected::double - actual::double) <= greatest(abs(expected::double) * 0.01::double, 1) passed from j where n >= 2""")
def row_sum_window(spark: SparkSession, d: str) -> DataFrame:
    """A user's errors as totals of the events since the error before, by the engine's check of row sums."""
    i = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    rows = _t(spark, d, "events").select("user_id", i.alias("row_idx"), F.when(F.col("event_type") == "error", "Total").otherwise("part").alias("label"), _money("value").alias("value"))
    found = ordered.row_sums(rows, ["user_id"])
    one = lambda c: F.col(c).cast("double")
    return found.select("user_id", "row_idx", one("expected").alias("expected"), one("actual").alias("actual"), "components", numbers.within(one("expected"), one("actual")).alias("passed"))


@query("""with y as (select n_name nation, year(o_orderdate) y, sum(cast(o_totalprice as decimal(18,2))) r from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
v as (select nation, y, r::double c, (lag(r) over (partition by nation order by y))::double p from y), w as (select *, (c - p) / abs(p) * 100 e, (y % 7)::double - 3 + (c - p) / abs(p) * 100 x from v where p is not null and p <> 0)
select nation, cast(y as integer) "year", round(e, 4) expected, round(abs(x - e), 4) difference, abs(y % 7 - 3) <= 0.5 passed from w""")
def variation_pct(spark: SparkSession, d: str) -> DataFrame:
    """Yearly revenue of a nation against the year before, reported with an error that the engine's check finds."""
    revenue = _revenue(spark, d).withColumn("p", F.lag("r").over(W.partitionBy("nation").orderBy("year")))
    rows = revenue.select("nation", "year", F.col("r").cast("double").alias("current"), F.col("p").cast("double").alias("prior"))
    told = rows.withColumn("reported", F.col("year") % 7 - 3 + numbers.variation(F.col("current"), F.col("prior")))
    found = ordered.variation_check(told)
    return found.select("nation", "year", F.round("expected", 4).alias("expected"), F.round("difference", 4).alias("difference"), "passed")


@query("""with y as (select n_name nation, year(o_orderdate) y, sum(cast(o_totalprice as decimal(18,2))) r from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
v as (select nation, y, r::double c, (lag(r) over (partition by nation order by y))::double p from y), w as (select *, case y % 3 when 0 then '' when 1 then '1000' else 'n.d.' end raw, (c - p) / abs(p) * 100 e from v)
select nation, cast(y as integer) "year", p is not null and p <> 0 and (raw <> '1000' or abs(1000 - e) > 5) corrected, case when p is not null and p <> 0 and (raw <> '1000' or abs(1000 - e) > 5) then replace(printf('%+.1f', e), '.', ',') || '%' else raw end variation from w""")
def variation_fix(spark: SparkSession, d: str) -> DataFrame:
    """Missing or wrong changes in percent written anew in French form."""
    revenue = _revenue(spark, d).withColumn("p", F.lag("r").over(W.partitionBy("nation").orderBy("year")))
    raw = F.when(F.col("year") % 3 == 0, "").when(F.col("year") % 3 == 1, "1000").otherwise("n.d.")
    rows = revenue.select("nation", "year", F.col("r").cast("double").alias("current"), F.col("p").cast("double").alias("prior"), raw.alias("variation"))
    return ordered.correct_variation(rows).select("nation", "year", F.coalesce("corrected", F.lit(False)).alias("corrected"), "variation")


def _revenue(spark: SparkSession, d: str) -> DataFrame:
    customers = _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    orders = _t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum(_money("o_totalprice")).alias("r"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation", "year").agg(F.sum("r").alias("r"))


@query("""with p as (select conv_id, turn page, case when turn % 2 = 0 then ['Label', 'Net'] else ['a', 'b'] end c, case when role = 'user' then [10.0, 20.0] else [10.0, 40.0] end x,
 case when turn % 3 = 1 then [['Net', 'Label'], ['r' || turn, '1']] else [['r' || turn, '1'], [case when turn % 5 = 4 then 'Total' else 's' || turn end, '2']] end r from conversations),
q as (select *, row_number() over (partition by conv_id order by page) n, lag(page) over (partition by conv_id order by page) pp, lag(r) over (partition by conv_id order by page) pr from p),
rec as (with recursive s as (select conv_id, n, page, c hc, x hx, r rows_, 0 as merged, r own from q where n = 1
 union all select q.conv_id, q.n, q.page, case when go then hc else q.c end, case when go then hx else q.x end, case when go then list_concat(rows_, case when dup then q.r[2:] else q.r end) else q.r end, case when go then merged else merged + 1 end, case when go and dup then q.r[2:] else q.r end
 from (select q.*, s.hc, s.hx, s.rows_, s.merged, s.page sp, q.r[1] = ['Net', 'Label'] and s.hc = ['Label', 'Net'] dup,
  q.page - s.page <= 1 and 1 + (case when list_aggregate(list_transform(range(1, 3), lambda i: case when abs(s.hx[i] - q.x[i]) < 5 then 1 else 0 end), 'sum') / 2.0 >= 0.8 then 1 else 0 end)
  + (case when q.r[1] = ['Net', 'Label'] and s.hc = ['Label', 'Net'] then 1 when q.r[1] = ['Net', 'Label'] then 0 else 0.5 end)
  + (case when len(list_filter(s.rows_[greatest(len(s.rows_) - 2, 1):], lambda y: contains(lower(y[1]), 'total'))) > 0 then 0 else 1 end) >= 2.5 as go from s join q on q.conv_id = s.conv_id and q.n = s.n + 1) q) select * from s)
select conv_id, cast(merged as integer) merged, cast(row_number() over (partition by conv_id, merged order by n, k) - 1 as integer) row_idx, hc[1] || '=' || row_[1] || ';' || hc[2] || '=' || row_[2] cells
from (select conv_id, merged, n, hc, unnest(own) row_, unnest(range(len(own))) k from rec)""")
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as fragments of tables on pages, put together by the engine's merger."""
    turn = F.col("turn")
    names = F.when(turn % 2 == 0, F.array(F.lit("Label"), F.lit("Net"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    offsets = F.when(F.col("role") == "user", F.array(F.lit(10.0), F.lit(20.0))).otherwise(F.array(F.lit(10.0), F.lit(40.0)))
    first = F.array(F.concat(F.lit("r"), turn.cast("string")), F.lit("1"))
    header = F.array(F.array(F.lit("Net"), F.lit("Label")), first)
    plain = F.array(first, F.array(F.when(turn % 5 == 4, "Total").otherwise(F.concat(F.lit("s"), turn.cast("string"))), F.lit("2")))
    tables = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("page"), F.lit(0).alias("table_idx"), names.alias("columns"), offsets.alias("x_offsets"), F.when(turn % 3 == 1, header).otherwise(plain).alias("rows"))
    shown = F.array_join(F.transform("cells", lambda c: F.concat_ws("=", c["name"], c["value"])), ";")
    return ordered.merge_pages(tables).select(F.col("doc_id").alias("conv_id"), "merged", "row_idx", shown.alias("cells"))


@query("""with s as (select doc_id, string_split(text, chr(10)) l, lang from documents), n as (select *, case when len(l) >= 3 then len(l) else 1 end k from s)
select doc_id, cast(i as integer) line, md5(case when k = 1 then array_to_string(l, chr(10)) else l[i + 1] end) cell, lang from (select *, unnest(range(k)) i from n)""")
def explode_merged(spark: SparkSession, d: str) -> DataFrame:
    """Texts of three lines or more, a row a line; the language repeats."""
    rows = spread(_t(spark, d, "documents").select("doc_id", "text", "lang"))
    return ordered.explode_merged_rows(rows, ["doc_id"], ["text", "lang"]).select("doc_id", "line", F.md5("text").alias("cell"), "lang")


@query("""with d as (select c_custkey document_id, case c_custkey % 3 when 0 then 'draft' when 1 then 'validated' else 'archived' end status, (c_custkey % 2)::int held from customer),
c as (select event_id, user_id document_id, case event_type when 'click' then 'validated' when 'view' then 'rejected' when 'purchase' then 'archived' else 'draft' end target, case when event_id % 4 = 0 then null else (event_id % 2)::int end version from events)
select event_id, target, cast(case when status is null then 404 when version is not null and version <> held then 412 when (status, target) not in (('draft', 'validated'), ('draft', 'rejected'), ('validated', 'archived')) then 409 else 200 end as integer) code,
case when status is not null and (version is null or version = held) and (status, target) in (('draft', 'validated'), ('draft', 'rejected'), ('validated', 'archived')) then target else status end new_status from c left join d using (document_id)""")
def state_machine(spark: SparkSession, d: str) -> DataFrame:
    """Events as review commands against customers as documents, with optimistic versions."""
    k = F.col("c_custkey") % 3
    documents = _t(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(k == 0, "draft").when(k == 1, "validated").otherwise("archived").alias("status"), (F.col("c_custkey") % 2).cast("int").alias("version"))
    target = F.when(F.col("event_type") == "click", "validated").when(F.col("event_type") == "view", "rejected").when(F.col("event_type") == "purchase", "archived").otherwise("draft")
    commands = _t(spark, d, "events").select("event_id", F.col("user_id").alias("document_id"), target.alias("target"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 2).cast("int")).alias("version"))
    return store.transition(documents, commands).select("event_id", "target", "code", "new_status")


# --- rules --------------------------------------------------------------------------------------------------------

def _sides(spark: SparkSession, d: str) -> DataFrame:
    customers = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(_money("c_acctbal")).alias("assets"))
    suppliers = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum(_money("s_acctbal")).alias("liabilities"))
    nations = F.broadcast(_t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation")))
    return customers.join(suppliers, "k", "full_outer").join(nations, "k").select("nation", F.col("assets").cast("double").alias("assets"), F.col("liabilities").cast("double").alias("liabilities"))


_SIDES = """with c as (select c_nationkey k, cast(sum(cast(c_acctbal as decimal(18,2))) as double) assets from customer group by 1), s as (select s_nationkey k, cast(sum(cast(s_acctbal as decimal(18,2))) as double) liabilities from supplier group by 1),
b as (select n_name nation, assets, liabilities from c full join s using (k) join nation on n_nationkey = k)"""


@query(_SIDES + """ select nation, 'V1-001 Balance Sheet Balance' check_name, abs(assets - coalesce(liabilities, 0)) <= greatest(abs(assets) * 0.01, 1) passed, coalesce(liabilities, 0) expected, assets actual, round(abs(assets - coalesce(liabilities, 0)), 2) difference from b where coalesce(assets, 0) <> 0""")
def balance_equation(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances as assets against suppliers' as liabilities, by the engine's balance rule."""
    rows = _sides(spark, d).select("nation", F.explode(F.array(F.struct(F.lit("Total actif").alias("label"), F.lit(0).alias("row_idx"), F.col("assets").alias("value")), F.struct(F.lit("Total passif").alias("label"), F.lit(1).alias("row_idx"), F.coalesce("liabilities", F.lit(0.0)).alias("value")))).alias("r")).select("nation", "r.*")
    return rules.balance(rows, ["nation"]).select("nation", "check_name", "passed", "expected", "actual", F.round("difference", 2).alias("difference"))


@query("""with l as (select l_orderkey k, sum(cast(l_extendedprice as decimal(18,2))) v from lineitem group by 1),
o as (select o_custkey custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) a, cast(sum(v) as double) b from orders left join l on k = o_orderkey group by 1)
select custkey, 'CRITICAL' severity, abs(a - b) <= greatest(abs(b) * 0.01, 1) passed, round(abs(a - b), 2) difference from o where b is not null""")
def cross_statement(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders against the lines of the same orders."""
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(_money("l_extendedprice")).alias("v"))
    both = _t(spark, d, "orders").join(lines, F.col("k") == F.col("o_orderkey"), "left").groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum(_money("o_totalprice")).cast("double").alias("cr_net"), F.sum("v").cast("double").alias("bilan_net"))
    wide = both.withColumns({"bilan_cash": F.lit(None).cast("double"), "tft_cash": F.lit(None).cast("double")})
    return rules.cross_statements(wide, ["custkey"]).select("custkey", "severity", "passed", F.round("difference", 2).alias("difference"))


@query("""with r as (select c_nationkey k, cast(min(cast(c_acctbal as decimal(18,2))) as double) lo, max(case when abs(c_acctbal) < 1 then 0 else floor(log10(abs(c_acctbal))) end) - min(case when abs(c_acctbal) < 1 then 0 else floor(log10(abs(c_acctbal))) end) spread, count(*) n from customer where c_acctbal <> 0 group by 1)
select cast(k as integer) nationkey, 'V3-001 Negative capital' check_name, lo actual from r where lo < 0 union all select cast(k as integer), 'V3-003 Magnitude', cast(spread as double) from r where n >= 3 and spread > 2""")
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Negative minima and spreads of account balances by nation."""
    rows = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("value"))
    low = rows.filter("value <> 0").groupBy("nationkey").agg(F.min(_money("value")).cast("double").alias("capital"))
    wide = low.withColumns({"fixed_assets": F.lit(0.0), "stocks": F.lit(0.0), "revenue": F.lit(1.0)})
    return rules.anomalies(wide, ["nationkey"]).unionByName(rules.magnitude(rows, ["nationkey"], 2)).select("nationkey", "check_name", "actual")


@query(_SIDES.replace("n_name nation", "r_name nation").replace("on n_nationkey = k", "on n_nationkey = k join region on r_regionkey = n_regionkey") + """, g as (select nation region, round(sum(cast(assets as decimal(18,2))) - sum(cast(liabilities as decimal(18,2))), 2) v from b group by 1)
select region, cast(v as double) working_capital, v >= 0 passed from g""")
def ratios(spark: SparkSession, d: str) -> DataFrame:
    nations = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    by = _sides(spark, d).join(F.broadcast(nations), "nation").groupBy("region").agg(F.sum(_money("assets")).cast("double").alias("equity"), F.sum(_money("liabilities")).cast("double").alias("fixed_assets"))
    found = rules.working_capital(by.withColumn("long_term_debt", F.lit(0.0)), ["region"])
    return found.select("region", F.round("actual", 2).alias("working_capital"), "passed")


@query(_SIDES + """, k as (select nation, 3 w, 'CRITICAL' s, abs(assets - coalesce(liabilities, 0)) <= greatest(abs(assets) * 0.01, 1) p from b where coalesce(assets, 0) <> 0 union all select nation, 1, 'WARNING', coalesce(assets - liabilities >= 0, true) from b)
select nation, count(*) total, count(*) filter (p) passed, count(*) filter (not p) failed, count(*) filter (not p and s = 'CRITICAL') critical, round(sum(case when p then w else 0 end)::double / sum(w), 6) score from k group by 1""")
def severity_report(spark: SparkSession, d: str) -> DataFrame:
    sides = _sides(spark, d)
    rows = sides.select("nation", F.explode(F.array(F.struct(F.lit("Total actif").alias("label"), F.lit(0).alias("row_idx"), F.col("assets").alias("value")), F.struct(F.lit("Total passif").alias("label"), F.lit(1).alias("row_idx"), F.col("liabilities").alias("value")))).alias("r")).select("nation", "r.*")
    wide = sides.select("nation", F.col("assets").alias("equity"), F.lit(0.0).alias("long_term_debt"), F.col("liabilities").alias("fixed_assets"))
    checks = rules.balance(rows, ["nation"]).unionByName(rules.working_capital(wide, ["nation"]))
    return rules.report(checks, ["nation"]).withColumn("score", F.round("score", 6))


@query("""select c_custkey custkey, "check" from (select c_custkey, unnest([case when not regexp_matches(c_name, '^Customer#[0-9]{9}$') then 'name' end, case when c_acctbal < 0 then 'balance' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'segment' end]) "check" from customer) where "check" is not null""")
def schema_validation(spark: SparkSession, d: str) -> DataFrame:
    checks = {"name": F.col("c_name").rlike("^Customer#[0-9]{9}$"), "balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return filters.schema_failures(_t(spark, d, "customer").withColumnRenamed("c_custkey", "custkey"), "custkey", checks)


# --- two sources, many sources --------------------------------------------------------------------------------------

def _source_b(orders: DataFrame) -> DataFrame:
    """A second reading of the orders: every 10th total is off by 5, every 17th order missing."""
    price = F.when(F.col("o_orderkey") % 10 == 0, _money("o_totalprice") + 5).otherwise(_money("o_totalprice"))
    return orders.filter("o_orderkey % 17 <> 0").select("o_orderkey", price.cast("double").alias("value"))


_PAIR = """with a as (select o_orderkey k, cast(cast(o_totalprice as decimal(18,2)) as double) an from orders where o_orderkey % 19 <> 0),
b as (select o_orderkey k, cast(cast(o_totalprice as decimal(18,2)) + case when o_orderkey % 10 = 0 then 5 else 0 end as double) bn from orders where o_orderkey % 17 <> 0)"""


@query(_PAIR + """ select coalesce(a.k, b.k) o_orderkey, coalesce(an, bn) as "value", case when abs(an - bn) <= 1 then 'consensus' when an is not null then 'tier0' else 'tier1' end provenance,
case when abs(an - bn) <= 1 then 'green' when an is not null and bn is not null then 'yellow' when an is null then 'yellow' else 'green' end flag, cast(case when abs(an - bn) <= 1 then 1.0 when an is not null and bn is not null then 0.85 else 0.9 end as double) confidence,
coalesce(abs(an - bn) > 1, false) conflict from a full join b on a.k = b.k""")
def dual_tier_merge(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    raw = lambda df: df.withColumn("raw_value", F.col("value").cast("string"))
    a = raw(orders.filter("o_orderkey % 19 <> 0").select("o_orderkey", _money("o_totalprice").cast("double").alias("value")))
    return align.reconcile(a, raw(_source_b(orders)), ["o_orderkey"]).select("o_orderkey", "value", "provenance", "flag", "confidence", "conflict")


@query("""with s as (select o_orderkey k, 'a' src, 0.5::double w, cast(cast(o_totalprice as decimal(18,2)) as double) v from orders union all select o_orderkey, 'b', 0.3, cast(cast(o_totalprice as decimal(18,2)) + case when o_orderkey % 10 = 0 then 5 else 0 end as double) from orders where o_orderkey % 17 <> 0
union all select o_orderkey, 'c', 0.2, cast(cast(o_totalprice as decimal(18,2)) + case when o_orderkey % 7 = 0 then 9 else 0 end as double) from orders where o_orderkey % 23 <> 0),
g as (select k, v, sum(cast(w as decimal(6,3))) w, min(src) src, count(*) m from s group by 1, 2), t as (select k, sum(w) tw, sum(m) n, count(*) c from g group by 1),
b as (select k, v, w from g qualify row_number() over (partition by k order by w desc, src) = 1)
select b.k o_orderkey, v as "value", round(case when c = 1 then 0 else 1 - w::double / tw::double end, 6)::double delta, cast(n as integer) n, case when c > 1 and 1 - w::double / tw::double >= 0.5 then 'red' when (c = 1 or 1 - w::double / tw::double <= 0.1) and n >= 2 then 'green' else 'yellow' end flag,
case when c = 1 and n >= 2 then 'consensus' else 'ensemble' end provenance, round(case when c = 1 then 1 else w::double / tw::double end, 3)::double confidence from b join t using (k)""")
def ensemble_vote(spark: SparkSession, d: str) -> DataFrame:
    """Three weighted readings of each order's total."""
    orders = _t(spark, d, "orders")
    a = orders.select("o_orderkey", F.lit("a").alias("source"), F.lit(0.5).alias("weight"), _money("o_totalprice").cast("double").alias("value"))
    b = _source_b(orders).select("o_orderkey", F.lit("b").alias("source"), F.lit(0.3).alias("weight"), "value")
    price = F.when(F.col("o_orderkey") % 7 == 0, _money("o_totalprice") + 9).otherwise(_money("o_totalprice"))
    c = orders.filter("o_orderkey % 23 <> 0").select("o_orderkey", F.lit("c").alias("source"), F.lit(0.2).alias("weight"), price.cast("double").alias("value"))
    return align.vote_cells(a.unionByName(b).unionByName(c), ["o_orderkey"])


@query("""with v as (select distinct p_name a, p_name || 's' b, substr(p_name, 2) c from part), n as (select a, levenshtein(a, b)::double / greatest(length(a), length(b)) ab, levenshtein(a, c)::double / greatest(length(a), length(c)) ac, levenshtein(b, c)::double / greatest(length(b), length(c)) bc from v)
select a p_name, cast(case when (ab + ac) / 2 <= (ab + bc) / 2 and (ab + ac) / 2 <= (ac + bc) / 2 then 0 when (ab + bc) / 2 <= (ac + bc) / 2 then 1 else 2 end as integer) "at", round(least((ab + ac) / 2, (ab + bc) / 2, (ac + bc) / 2), 6) delta from n""")
def text_medoid(spark: SparkSession, d: str) -> DataFrame:
    """The most central of three spellings of a part name."""
    names = _t(spark, d, "part").select("p_name").distinct().withColumn("s", F.array("p_name", F.concat("p_name", F.lit("s")), F.expr("substring(p_name, 2)")))
    return names.withColumn("m", align.medoid(F.col("s"))).select("p_name", F.col("m.at").alias("at"), F.round("m.delta", 6).alias("delta"))


@query("""with a as (select o_custkey k, o_orderstatus s, o_orderkey i, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) n from orders), b as (select o_custkey k, o_orderstatus s, o_orderkey i, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) n from orders where o_orderkey % 5 <> 0)
select a.k custkey, a.i a_idx, b.i b_idx, case when b.i is null then 'a_orphan' else 'position' end "method" from a left join b on a.k = b.k and a.s is not distinct from b.s and a.n = b.n""")
def positional_align(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer against a reading that lacks every fifth: labels say nothing, so the position in the status does."""
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("row_idx"), F.lit(None).cast("string").alias("canonical"), F.col("o_orderstatus").alias("section"))
    found = align.align_rows(orders.withColumn("label", F.lit("aaaa")), orders.filter("row_idx % 5 <> 0").withColumn("label", F.lit("zzzz")), ["custkey"])
    return found.select("custkey", "a_idx", "b_idx", "method")


@query(f"""with n as (select p_brand brand, p_name, cast(row_number() over (partition by p_brand order by p_name) as integer) i from (select distinct p_brand, p_name from part)),
u as (select distinct a.p_name x, b.p_name || 'x' y from n a join n b using (brand)), sc as (select x, y, {indel_sql("x", "y")} / 100 s from u),
pr as (select a.brand, a.i a_idx, b.i b_idx, s from n a join n b using (brand) join sc on x = a.p_name and y = b.p_name || 'x' where s >= 0.7),
od as (select *, row_number() over (partition by brand order by s desc, a_idx, b_idx) o from pr),
two as (with recursive g as (select brand, 0::bigint o, [0] ua, [0] ub, 0 a_idx, 0 b_idx, 0.0::double s, false took from (select distinct brand from n)
 union all select g.brand, od.o, case when ok then list_append(ua, od.a_idx) else ua end, case when ok then list_append(ub, od.b_idx) else ub end, od.a_idx, od.b_idx, od.s, ok
 from g join od on od.brand = g.brand and od.o = g.o + 1, lateral (select not list_contains(ua, od.a_idx) and not list_contains(ub, od.b_idx) ok) z) select brand, a_idx, b_idx, s from g where took),
ra as (select brand, i, row_number() over (partition by brand order by i) k from n where (brand, i) not in (select brand, a_idx from two)), rb as (select brand, i, row_number() over (partition by brand order by i) k from n where (brand, i) not in (select brand, b_idx from two)),
th as (select ra.brand, ra.i a_idx, rb.i b_idx from ra join rb using (brand, k))
select brand, a_idx, b_idx, 'text' "method", round(s, 6) score from two union all select brand, a_idx, b_idx, 'position', 0.5 from th
union all select brand, i, null, 'a_orphan', 0 from ra where (brand, i) not in (select brand, a_idx from th) union all select brand, null, i, 'b_orphan', 0 from rb where (brand, i) not in (select brand, b_idx from th)""")
def greedy_text_align(spark: SparkSession, d: str) -> DataFrame:
    """Part names of a brand against their misspelt twins: four-phase alignment."""
    names = _t(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_name").distinct()
    n = F.row_number().over(W.partitionBy("brand").orderBy("p_name")).cast("int")
    rows = names.select("brand", n.alias("row_idx"), F.col("p_name").alias("label"), F.lit(None).cast("string").alias("canonical"), F.lit("s").alias("section"))
    twin = rows.withColumn("label", F.concat("label", F.lit("x")))
    return align.align_rows(rows, twin, ["brand"]).withColumn("score", F.round("score", 6))


# --- store --------------------------------------------------------------------------------------------------------

@query("""select o_custkey document_id, o_orderkey job_id, o_orderstatus status from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return store.latest_job(jobs).select("document_id", "job_id", "status")


@query("""with j as (select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select c_custkey document_id, o_orderkey job_id, o_totalprice qcs from customer left join j on o_custkey = c_custkey where c_nationkey = 3""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """One tenant's documents with their latest job."""
    documents = _t(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("created_at"))
    jobs = _t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("qcs"), F.col("o_orderdate").alias("created_at"))
    return store.review_queue(documents, jobs, 3).select("document_id", "job_id", "qcs")


@query("""with j as (select *, o_totalprice > 200000 review, cast(cast(o_totalprice as decimal(18,2)) as double) / 1000000 q from orders where o_orderstatus = 'F'), f as (select count(distinct user_id) c from events where event_type = 'error')
select count(*) jobs, round(count(*) filter (not review)::double / count(*), 6) automation_rate, round(1 - count(*) filter (not review)::double / count(*), 6) review_rate, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 1000000 / count(*), 6) avg_qcs, round(max(c)::double / count(*), 6) correction_rate from j, f""")
def kpi_quality(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), (F.col("o_totalprice") > 200000).alias("needs_review"), (_money("o_totalprice").cast("double") / 1000000).alias("qcs"))
    fixed = _t(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("document_id"))
    found = store.quality_kpis(jobs, fixed)
    return found.select("jobs", *[F.round(c, 6).alias(c) for c in ("automation_rate", "review_rate", "avg_qcs", "correction_rate")])


@query("""with j as (select user_id, count(*) total, count(*) filter (event_type <> 'error') passed, count(*) filter (event_type = 'error' and value > 50) critical from events group by 1)
select round(avg(passed::double / total), 6) pass_rate, round(avg((critical > 0)::int), 6) critical_rate from j""")
def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    reports = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("passed"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 50)).alias("critical"))
    return store.rule_flags(reports).select(F.round("pass_rate", 6).alias("pass_rate"), F.round("critical_rate", 6).alias("critical_rate"))


@query("""select cast(props->>'k' as integer) k, event_type, count(*) n from events group by 1, 2""")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_totalprice, (select count(*) from orders) total from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def paged_list(spark: SparkSession, d: str) -> DataFrame:
    """The third page of orders with the count of all."""
    orders = _t(spark, d, "orders")
    total = store.total(orders)
    return store.page(orders, F.col("o_orderdate").desc(), F.col("o_orderkey"), offset=100).join(total).select("o_orderkey", "o_totalprice", "total")


@query("""with s as (select cast(user_id % 50 + floor(value)::bigint * 50 as varchar) raw_text, event_type matched_to, count(*) n from events where event_type in ('error', 'purchase') group by 1, 2) select raw_text, matched_to, n from (select *, count(*) over (partition by raw_text) c from s) where n >= 3 and c = 1""")
def promotable(spark: SparkSession, d: str) -> DataFrame:
    log = _t(spark, d, "events").filter("event_type in ('error', 'purchase')").select((F.col("user_id") % 50 + F.floor("value") * 50).cast("string").alias("raw_text"), F.col("event_type").alias("matched_to"))
    return store.promotable(log)


@query("""select user_id principal, cast(time_bucket(interval '1 hour', ts) as timestamp) "start", count(*) n from events group by 1, 2 having count(*) > 1""")
def tumbling_rate(spark: SparkSession, d: str) -> DataFrame:
    """Principals over a limit of one event an hour."""
    requests = _t(spark, d, "events").select(F.col("user_id").alias("principal"), F.col("ts").cast("timestamp").alias("ts"))
    return store.rate_limited(requests, 1, "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


_HOSTS = ["http://[::1]/x", "http://[fd00::1]/", "http://10.0.0.7/", "http://172.31.0.1:80", "http://172.32.0.1", "https://a.internal/y", "http://printer.local", "http://224.0.0.1", "http://localhost:8080", "http://[2606:4700::1111]/", "ftp://example.com", "https://u:p@example.com:8443/", "http://8.8.8.8", "http://[::ffff:127.0.0.1]/"]
_GUARDED = {0: False, 1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 8: False, 9: True, 10: False, 11: True, 12: True, 13: False}


@query("select page_id, case page_id % 15 " + " ".join(f"when {i} then {str(ok).lower()}" for i, ok in _GUARDED.items()) + " else regexp_matches(lower(url), '^https?://[a-z]') and not regexp_matches(lower(url), '^[a-z]+://(localhost|[^/:?#]*[.](internal|local))([/:?#]|$)') end allowed from pages")
def url_guard(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses, fourteen of every fifteen replaced by ones that a guard must know."""
    url = F.coalesce(F.get(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % 15).cast("int")), F.col("url"))
    return _t(spark, d, "pages").select("page_id", filters.url_allowed(url).alias("allowed"))


@query("""with c as (select doc_id, case when n_chars < 200 then 'Autre' else 'Bilan' end category, 0.5 + (doc_id % 50) / 100.0::double confidence, doc_id % 3 = 0 green, 0.90 + (doc_id % 10) / 100.0::double q0, 0.5 + (doc_id % 40) / 100.0::double q1, 0.6 + (doc_id % 30) / 100.0::double q3, doc_id % 7 = 0 crit from documents)
select doc_id, cast(case when category = 'Autre' or confidence < 0.7 then -1 when green and q0 >= 0.95 then 0 when q1 >= 0.75 then 1 when q3 >= 0.75 and not crit then 3 else 4 end as integer) tier,
case when category = 'Autre' or confidence < 0.7 then 'REJECTED' when (green and q0 >= 0.95) or q1 >= 0.75 or (q3 >= 0.75 and not crit) then 'ACCEPTED' else 'REVIEW' end status,
cast(case when category = 'Autre' or confidence < 0.7 then 0 when green and q0 >= 0.95 then 1 when q1 >= 0.75 then 2 else 4 end as integer) attempts from c""")
def cascade_route(spark: SparkSession, d: str) -> DataFrame:
    """Documents through the cascade of tiers, scores made from their ids."""
    share = lambda n: (F.col("doc_id") % n) / F.lit(100.0)
    docs = _t(spark, d, "documents").select(
        "doc_id", F.when(F.col("n_chars") < 200, "Autre").otherwise("Bilan").alias("category"), (0.5 + share(50)).alias("confidence"), (F.col("doc_id") % 3 == 0).alias("green"),
        (0.90 + share(10)).alias("qcs0"), (0.5 + share(40)).alias("qcs1"), (0.6 + share(30)).alias("qcs3"), (F.col("doc_id") % 7 == 0).cast("int").alias("critical3"),
    )
    return route.cascade(docs).select("doc_id", "tier", "status", F.size("attempts").alias("attempts"))


# --- the relational built-ins that the statement engine rests on ------------------------------------------------------

@query("""select r_name, o_orderpriority, count(*) n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) total, cast(grouping(r_name) + 2 * grouping(o_orderpriority) as integer) level from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by cube (r_name, o_orderpriority)""")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    places = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.cube("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(_money("o_totalprice")).cast("double").alias("total"), (F.grouping("r_name") + 2 * F.grouping("o_orderpriority")).cast("int").alias("level"))


@query("""select k, count(*) n from ((select c_nationkey k from customer intersect select s_nationkey from supplier) union all (select c_nationkey from customer except select n_nationkey from nation where n_regionkey = 1)) group by 1""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = _t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    return c.intersect(s).unionAll(c.subtract(n)).groupBy("k").agg(F.count("*").alias("n"))


@query("""select l_partkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) total from lineitem group by 1 order by sum(cast(l_extendedprice as decimal(18,2))) desc, l_partkey limit 20""")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    by = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(_money("l_extendedprice")).alias("t"))
    return by.orderBy(F.col("t").desc(), "l_partkey").limit(20).select("l_partkey", F.col("t").cast("double").alias("total"))


@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) sum_base_price, round(cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*), 6) avg_disc, count(*) count_order from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(_money("l_quantity")).cast("double").alias("sum_qty"), F.sum(_money("l_extendedprice")).cast("double").alias("sum_base_price"), F.round(F.sum(_money("l_discount")).cast("double") / F.count("*"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


from . import statements  # noqa: E402, F401  (registers its queries)
