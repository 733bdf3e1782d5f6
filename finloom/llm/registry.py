"""The corpus operators' contract queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, licenses, linededup, mixing, neardup, pii, quality, suffixes, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "template", "license", "n_template", "n_shared", "containment")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), columns=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


def _listed(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.find_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), (F.size("pii") > 0).alias("has_pii"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "hit_runs", "items", "near_items").select(
        "doc_id",
        "n_words",
        decontam.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_licenses, op3_mixing, op4_html, op5_suffix_dedup, op6_near_duplicates, op7_pii, op8_quality, op9_decontamination, op10_line_dedup)}

_W = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {}

ORACLES["op8_quality"] = rf"""
with a as (select doc_id, coalesce(text, '') t from documents),
b as (select doc_id, t, regexp_extract_all(t, '{_W}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from a),
c as (select *, case when len(w) < 3 then [] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end g from b),
n as (select row_number() over () rid, * from c),
rep as (select rid, i, count(*) over (partition by rid, g) k from (select rid, unnest(range(1, len(g) + 1)) i, unnest(g) g from n)),
cov as (select rid, count(distinct i + o) n from rep, (values (0), (1), (2)) v(o) where k > 1 group by rid),
f as (select doc_id, cast(len(w) as bigint) n_words, cast(length(list_aggregate(w || [''], 'string_agg', '')) as bigint) word_chars,
 cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, cast(len(l) as bigint) n_lines,
 cast(coalesce(cov.n, 0) as bigint) n_repeat_words, lower(t) <> t and upper(t) = t caps,
 len(regexp_extract_all(t, '(?i)lorem ipsum')) lorem, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) ell, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) bul,
 len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-@\[-`\x7B-\x7F]'))) alpha from n left join cov using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or caps or word_chars < 2 * n_words or word_chars > 20 * n_words
 or lorem > 0 or (n_lines >= 4 and (10 * ell > 3 * n_lines or 10 * bul > 9 * n_lines)) or 2 * alpha < n_words) kept from f
"""

#: Targets: sources by size over weight; the longest prefix of them that a share would lift above three times is full.
ORACLES["op3_mixing"] = rf"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{_W}')), 0) as bigint) size,
 cast('0x' || substr(md5(coalesce(cast(doc_id as varchar) || '|', '') || coalesce(text || '|', '')), 1, 15) as bigint) h from documents),
s as (select source, sum(size)::bigint n from d group by source),
o as (select source, n, [5, 2, 1][1 + cast((row_number() over (order by source nulls last) - 1) % 3 as integer)] w from s),
f as (select *, row_number() over r k, sum(3 * n) over r - 3 * n full_before, sum(w) over r - w w_before, sum(n) over () total, sum(w) over () w_all from o window r as (order by n::double / w, w, source nulls last)),
g as (select *, (total - full_before)::double / (w_all - w_before) * w > 3 * n above from f),
c as (select coalesce(max(k) filter (above), 0) m from g),
t as (select source, n, case when k <= m then 3.0::double * n else (total - (select coalesce(sum(3 * n), 0) from g where k <= m))::double / (w_all - (select coalesce(sum(w), 0) from g where k <= m)) * w end target from g, c),
e as (select source, n, target, case when n > 0 then least(3, cast(floor(target / n) as bigint)) else 0 end whole from t),
b as (select source, h, sum(size)::bigint z from d group by source, h),
u as (select source, h, z, sum(z) over (partition by source order by h) up from b),
x as (select u.source, h, z, up, target - whole * n want from u join e on u.source is not distinct from e.source where whole < 3 and n > 0 and target - whole * n > 0),
q as (select source, min((h, up, z, want)) filter (up >= want) p, max(h) + 1 past from x group by source),
cut as (select source, case when p is null then past else p[1] + case when p[2] - p[4] <= p[4] - (p[2] - p[3]) then 1 else 0 end end cut from q)
select doc_id, size, cast(e.n as bigint) source_size, target, cast(size * (whole + case when h < coalesce(cut, 0) then 1 else 0 end) as bigint) taken
from d join e on d.source is not distinct from e.source left join cut on d.source is not distinct from cut.source
"""

#: Exact similarity of all texts that share a shingle, and the closure of the links; texts are numbered by their content.
ORACLES["op6_near_duplicates"] = rf"""
with recursive d as (select doc_id, coalesce(doc_id, 9223372036854775807) id, dense_rank() over (order by coalesce(text, '')) t, coalesce(text, '') x from documents),
u as (select t, regexp_extract_all(lower(any_value(x)), '{_W}') w from d group by t),
g as (select distinct t, list_aggregate(w[i:i + 4], 'string_agg', ' ') g from (select t, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from u where len(w) > 0)),
n as (select t, count(*) n from g group by t),
p as (select a.t a, b.t b, count(*) k from g a join g b on a.g = b.g and a.t < b.t group by 1, 2),
l as (select a, b from p join n na on na.t = a join n nb on nb.t = b where k >= 0.8::double * (na.n + nb.n - k)),
e as (select a, b from l union select b, a from l), r as (select t a, t b from u union select r.a, e.b from r join e on e.a = r.b),
c as (select r.a t, min(d.id) m from r join d on d.t = r.b group by 1)
select doc_id, case when m <> 9223372036854775807 then m end class_id from d join c using (t)
"""

#: Texts as hexadecimal digits, cut into pieces of 2,000 bytes with the 49 after them, so that windows are cut from short strings.
ORACLES["op5_suffix_dedup"] = """
with d as (select row_number() over () rid, doc_id, coalesce(doc_id, 9223372036854775807) id, hex(encode(coalesce(text, ''))) h from documents),
b as (select *, length(h) // 2 n from d),
c as (select rid, id, o, substr(h, 2 * o + 1, 4098) s from (select *, unnest(range(0, n, 2000)) o from b)),
w as (select rid, id, o + j p, substr(s, 2 * j + 1, 100) g from (select *, unnest(range(0, least(2000, length(s) // 2 - 49))) j from c)),
f as (select g, min(id) lowest from w group by g having min(id) < max(id)),
e as (select rid, p, case when p - lag(p) over (partition by rid order by p) <= 50 then 0 else 1 end fresh from (select w.rid, w.p from w join f using (g) where w.id > f.lowest)),
r as (select rid, p, sum(fresh) over (partition by rid order by p) k from e), s as (select rid, k, min(p) a, max(p) + 50 z from r group by rid, k),
t as (select rid, count(*) n_spans, sum(z - a) n_removed, list(a order by a) a, list(z order by a) z from s group by rid),
k as (select b.*, coalesce(n_spans, 0) n_spans, coalesce(n_removed, 0) n_removed, list_prepend(0, coalesce(z, [])) begins, list_append(coalesce(a, []), n) ends from b left join t using (rid))
select doc_id, cast(n as bigint) n_bytes, cast(n_removed as bigint) n_removed, cast(n_spans as bigint) n_spans,
 sha256(unhex(array_to_string(list_transform(range(1, len(begins) + 1), lambda i: substr(h, 2 * begins[i] + 1, 2 * (ends[i] - begins[i]))), ''))) kept_sha256 from k
"""

_F = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op9_decontamination"] = rf"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all({_LOW.format("text")}, '{_F}') w from documents),
bt as (select distinct coalesce(cast(item_id as varchar), '') item, text from benchmark where text is not null),
b as (select item, regexp_extract_all({_LOW.format("text")}, '{_F}') w from bt),
bw as (select distinct item, least(len(w), 10) k, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') g
 from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select rid, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') g from (select rid, k, w, unnest(range(1, len(w) - k + 2)) i from d, ks where len(w) >= k)),
hits as (select distinct rid, i, dw.k, item from dw join bw on dw.g = bw.g and dw.k = bw.k),
cov as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + k)) p from (select distinct rid, i, k from hits)) group by rid),
its as (select rid, count(*) n, string_agg(item, ',' order by item) s from (select distinct rid, item from hits) group by rid),
often as (select x, count(*) n from (select unnest(regexp_extract_all({_LOW.format("text")}, '{_F}')) x from (select distinct text from bt)) group by x),
wo as (select g, o, x from (select g, unnest(string_split(g, ' ')) x, unnest(range(k)) o from (select distinct g, k from bw where k >= 4))),
ky as (select g, o, x, row_number() over (partition by g order by n, o) r from wo join often using (x) qualify r <= 6),
sp as (select rid, p, x from (select rid, unnest(w) x, unnest(range(len(w))) p from d) semi join ky using (x)),
pl as (select rid, g, r, p, p - o spot from sp join ky using (x)),
nr as (select distinct a.rid, a.g from pl a join pl c on a.rid = c.rid and a.g = c.g and c.spot between a.spot - 3 and a.spot + 3 where a.r <= 3 group by a.rid, a.g, a.r, a.p having count(distinct c.r) >= 4),
ni as (select rid, count(distinct item) n from nr join bw using (g) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(cov.n, 0) as bigint) n_hit, cast(coalesce(its.n, 0) as bigint) n_items,
 sha256(coalesce(its.s, '')) items_sha256, cov.n is not null contaminated, cast(coalesce(ni.n, 0) as bigint) n_near_items
from d left join cov using (rid) left join its using (rid) left join ni using (rid)
"""

ORACLES["op10_line_dedup"] = rf"""
with d as (select row_number() over () rid, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
x as (select rid, doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from x),
f as (select key, min(doc_id) first from k where length(key) >= 10 group by key),
m as (select k.*, coalesce(f.first < k.doc_id, false) gone from k left join f using (key))
select doc_id, cast(count(*) as bigint) n_lines, cast(count(*) filter (gone) as bigint) n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from m group by rid, doc_id
"""

_T = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
ORACLES["op2_licenses"] = rf"""
with t as (select template, license, regexp_extract_all(lower(text), '{_F}') w from (values {_T}) v(template, license, text)),
ts as (select distinct template, license, list_aggregate(w[i:i + 4], 'string_agg', ' ') g from (select *, unnest(range(1, len(w) - 3)) i from t)),
d as (select row_number() over () rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_F}') w from documents),
ds as (select distinct rid, doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') g from (select *, unnest(range(1, len(w) - 3)) i from d where len(w) > 4)),
n as (select template, count(*) n from ts group by template),
m as (select rid, doc_id, template, any_value(license) license, count(*) k from ds join ts using (g) group by rid, doc_id, template)
select doc_id, cast(template as integer) template, license, n n_template, k n_shared, k::double / n containment from m join n using (template) where k::double / n >= 0.8
"""


def _swapped(sql: str, *pairs: tuple[str, str]) -> str:
    """sql with each text replaced, which must be there."""
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"not in the query: {old}")
        sql = sql.replace(old, new)
    return sql


def pipeline_sql() -> str:
    """The five stages of the corpus pipeline as one query: each twin reads the stage before and hands on the rows."""
    row = "struct_pack(\"text\" := text, lang := lang, source := source, n_chars := n_chars) row_"
    fields = "row_.\"text\" as text, row_.lang lang, row_.source source, row_.n_chars n_chars"
    quality_ = _swapped(
        ORACLES["op8_quality"], ("coalesce(text, '') t from documents", f"coalesce(text, '') t, {row} from documents"), ("b as (select doc_id, t,", "b as (select doc_id, t, row_,"), ("f as (select doc_id,", "f as (select doc_id, row_,"), ("select doc_id, n_words, word_chars,", f"select doc_id, {fields}, n_words, word_chars,")
    )
    lines = ORACLES["op10_line_dedup"]
    lines = _swapped(lines[: lines.index("select doc_id, cast(count(*)")], ("l from documents", f"l, {row} from documents"), ("select rid, doc_id, unnest(l) line", "select rid, doc_id, row_, unnest(l) line"), ("from documents", "from s1"))
    lines += "select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text, any_value(row_).lang lang, any_value(row_).source source from m group by rid, doc_id"
    near = ORACLES["op6_near_duplicates"]
    near = _swapped(near[: near.index("select doc_id, case when m")], ("coalesce(text, '') x from documents", f"coalesce(text, '') x, {row} from s2"))
    near += f"select doc_id, {fields} from d join c using (t) where id = m"
    leaks = ORACLES["op9_decontamination"]
    leaks = _swapped(leaks[: leaks.index("cov as (")].rstrip().rstrip(","), (" w from documents", f" w, {row} from s3"))
    leaks += f" select doc_id, {fields} from d where rid not in (select rid from hits)"
    mix = _swapped(ORACLES["op3_mixing"], ("select doc_id, source, cast(", f"select doc_id, source, {row}, cast("), ("as bigint) h from documents", "as bigint) h from s4"), ("select doc_id, size, cast(e.n", f"select doc_id, {fields}, size, cast(e.n"))
    return (
        f"with s1 as (select doc_id, text, lang, source, n_chars from ({quality_}) where kept), s2 as (select *, cast(length(text) as bigint) n_chars from ({lines})), "
        f"s3 as ({near}), s4 as ({leaks}) select * from ({mix}) where taken > 0"
    )
