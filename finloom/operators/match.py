"""Dictionary matching: a cascade of joins, each stage on the rows that the ones before left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import similarity, text
from ..storage import stored

#: A dimension of at most so many rows is broadcast; the count is checked.
BROADCAST_ROWS = 200_000


def dimension(dim: DataFrame) -> DataFrame:
    """The dimension, with a broadcast hint only where its counted size allows it."""
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def pinned(dim: DataFrame, rows: int = 20_000) -> DataFrame:
    """A small dimension computed once and carried as literal rows; a larger one stays as it is."""
    found = dim.limit(rows + 1).collect()
    return dim.sparkSession.createDataFrame(found, dim.schema) if len(found) <= rows else dim


def term_index(terms: DataFrame) -> DataFrame:
    """(form, kind, canonical, statement, section, ord): normal forms of canonical labels, then of variations; first wins."""
    canonical = terms.select(text.normalize(F.col("canonical")).alias("form"), F.lit(0).alias("kind"), "canonical", "statement", "section", "ord")
    varied = terms.select(F.explode("variations").alias("v"), "canonical", "statement", "section", "ord")
    variations = varied.select(text.normalize(F.col("v")).alias("form"), F.lit(1).alias("kind"), "canonical", "statement", "section", "ord")
    w = W.partitionBy("form").orderBy("kind", "ord")
    return canonical.unionByName(variations).filter("form <> ''").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def exact_lookup(labels: DataFrame, index: DataFrame, label: str = "label") -> DataFrame:
    """labels with canonical and match_type (exact, resolved or NULL)."""
    keyed = labels.withColumn("form", text.normalize(F.col(label)))
    hit = keyed.join(dimension(index), "form", "left")
    return hit.withColumn("match_type", F.when(F.col("kind") == 0, "exact").when(F.col("kind") == 1, "resolved")).drop("form", "kind", "ord")


def lookup_account(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (account_code) with the first term of that account."""
    first = terms.groupBy("account_code").agg(F.min_by("canonical", "ord").alias("canonical"))
    return rows.join(dimension(first), "account_code", "left")


def validation_field(rows: DataFrame, index: DataFrame, fields: DataFrame) -> DataFrame:
    return exact_lookup(rows, index).join(dimension(fields), "canonical", "left")


def scoped_terms(terms: DataFrame) -> DataFrame:
    """terms once for each scope that they are searched in: their section, their statement, everything."""
    scopes = F.array_compact(F.array(F.concat(F.lit("s:"), "section"), F.concat(F.lit("t:"), "statement"), F.lit("a")))
    return terms.withColumn("scope", F.explode(scopes))


def scope_of(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """labels with scope: the section if terms have it, else the statement if terms have it, else everything."""
    out = labels
    for column, prefix in (("section", "s"), ("statement", "t")):
        if column in labels.columns:
            known = terms.select(F.col(column).alias(f"__{prefix}")).filter(F.col(f"__{prefix}").isNotNull()).distinct()
            out = out.join(dimension(known), F.col(column) == F.col(f"__{prefix}"), "left")
        else:
            out = out.withColumn(f"__{prefix}", F.lit(None).cast("string"))
    return out.withColumn("scope", F.coalesce(F.concat(F.lit("s:"), "__s"), F.concat(F.lit("t:"), "__t"), F.lit("a"))).drop("__s", "__t")


def blocked_pairs(left: DataFrame, right: DataFrame, key: str, edge: str = "") -> DataFrame:
    """Candidate pairs (scope, l, r) of distinct strings of one scope that share two neighbouring characters; a string of
    one character pairs with those that hold it. An equi-join, never all pairs.

    With an edge character at both ends the pairs are complete for ratios from 75 up: of the n + 1 two-grams of a string
    a removed character spoils two and an added one spoils one, and a ratio of 75 leaves so few of them that at most 0.8 n
    are spoilt. Without edges they are complete for windows of ratio 85 up.
    """
    def grams(df: DataFrame, name: str) -> DataFrame:
        padded = f"concat('{edge}', {name}, '{edge}')"
        cut = f"case when length({padded}) < 2 then array(cast(null as string)) else array_distinct(transform(sequence(1, length({padded}) - 1), i -> substring({padded}, i, 2))) end"
        return df.select("scope", F.col(key).alias(name)).filter(F.col(name) != "").distinct().select("scope", name, F.explode(F.expr(cut)).alias("g"))

    def characters(df: DataFrame, name: str) -> DataFrame:
        return df.select("scope", F.col(key).alias(name)).distinct().select("scope", name, F.explode(F.array_distinct(F.filter(F.split(name, ""), lambda c: c != ""))).alias("g"))

    def single(df: DataFrame, name: str) -> DataFrame:
        return df.select("scope", F.col(key).alias(name), F.col(key).alias("g")).filter(F.length(name) == 1).distinct()

    pairs = grams(left, "l").join(grams(right, "r"), ["scope", "g"])
    if not edge:
        pairs = pairs.unionByName(single(left, "l").join(characters(right, "r"), ["scope", "g"])).unionByName(characters(left, "l").join(single(right, "r"), ["scope", "g"]))
    return pairs.select("scope", "l", "r").distinct()


def fuzzy_match(labels: DataFrame, terms: DataFrame, approved: DataFrame | None = None, customs: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """labels (label, and section or statement where known) with canonical, match_type and match_confidence.

    Empty labels are unrecognized and confirmed customs (by the label as written) custom, both with confidence 0. Then,
    among the terms of the label's scope: the canonical form (1.0), a variation (0.98), an approved meaning of the label as
    written whose term exists (0.98), the best token-sorted ratio and then the best partial ratio of canonical forms, from
    85 up. What is left is custom, with the best token-sorted ratio from 75 up as confidence. Ties go to the first term.
    Similarities are computed once for each distinct form, scope and term.
    """
    rows = scope_of(labels, terms).withColumn("form", text.normalize(F.coalesce(F.col("label"), F.lit(""))))
    asked = stored(rows.select("label", "form", "scope").distinct(), "labels")
    # canonical forms before variations, first terms first
    entries = scoped_terms(terms.select("canonical", "section", "statement", "variations", "ord"))
    given = entries.select("scope", "canonical", "ord", text.normalize(F.col("canonical")).alias("form"), F.lit(0).alias("kind"))
    varied = entries.select("scope", "canonical", "ord", F.explode("variations").alias("v")).select("scope", "canonical", "ord", text.normalize(F.col("v")).alias("form"), F.lit(1).alias("kind"))
    index = given.unionByName(varied).filter("form <> ''").groupBy("scope", "form").agg(F.min(F.struct("kind", "ord", "canonical")).alias("e"))
    found = asked.join(dimension(index.select("scope", "form", "e")), ["scope", "form"], "left")
    if approved is not None:
        whole = index.filter("scope = 'a' and e.kind = 0").select(F.col("form").alias("__f"), F.col("e.canonical").alias("override"))
        meant = approved.select(F.col("raw_text").alias("label"), text.normalize(F.col("matched_to")).alias("__f")).join(whole, "__f").select("label", "override")
        found = found.join(dimension(meant), "label", "left")
    else:
        found = found.withColumn("override", F.lit(None).cast("string"))
    if customs is not None:
        found = found.join(dimension(customs.select("label").distinct().withColumn("custom", F.lit(True))), "label", "left")
    else:
        found = found.withColumn("custom", F.lit(None).cast("boolean"))
    hit = F.when(F.col("custom"), F.lit(None)).otherwise(F.coalesce("e.canonical", "override"))
    found = stored(found.withColumn("hit", hit), "found")
    # similarity: of terms with one form the last counts, at the place of the first
    candidates = given.filter("form <> ''").groupBy("scope", "form").agg(F.min("ord").alias("ord"), F.max_by("canonical", "ord").alias("term"))
    candidates = stored(candidates, "candidates").withColumns({"plain": text.lexical_normal(F.col("form")), "sorted": text.sorted_tokens(F.col("form"))})
    open_ = found.filter(F.col("hit").isNull() & F.col("custom").isNull() & (F.col("form") != "")).select("scope", "form").distinct()
    open_ = open_.withColumns({"plain": text.lexical_normal(F.col("form")), "sorted": text.sorted_tokens(F.col("form"))})

    def best(forms: DataFrame, key: str, score, edge: str, name: str) -> DataFrame:
        pairs = blocked_pairs(forms, candidates, key, edge).withColumn("score", score(F.col("l"), F.col("r")))
        named = pairs.join(dimension(candidates.select("scope", F.col(key).alias("r"), "term", "ord")), ["scope", "r"])
        top = named.groupBy("scope", F.col("l").alias(key)).agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "term")).alias(name))
        return forms.join(top, ["scope", key], "left")

    by_sorted = stored(best(open_, "sorted", similarity.indel_ratio, "\u0001", "s"), "sorted")
    sure = F.coalesce(F.col("s.score") >= config.fuzzy_cut, F.lit(False))
    by_partial = best(by_sorted.filter(~sure).drop("s"), "plain", similarity.partial_indel, "", "p").select("scope", "form", "p")
    out = found.join(by_sorted.select("scope", "form", "s"), ["scope", "form"], "left").join(by_partial, ["scope", "form"], "left")
    sure, partly = F.col("s.score") >= config.fuzzy_cut, F.col("p.score") >= config.fuzzy_cut
    exact, known = F.col("e").isNotNull() & (F.col("e.kind") == 0), F.col("hit").isNotNull()
    none = (F.col("form") == "") | F.coalesce(F.col("custom"), F.lit(False))
    out = out.select(
        "label",
        "scope",
        F.when(F.col("form") == "", None).otherwise(F.coalesce("hit", F.when(sure, F.col("s.term")).when(partly, F.col("p.term")))).alias("canonical"),
        F.when(F.col("form") == "", "unrecognized").when(F.col("custom"), "custom").when(exact, "exact").when(known, "resolved").when(sure | partly, "fuzzy").otherwise("custom").alias("match_type"),
        F.when(none, 0.0)
        .when(exact, 1.0)
        .when(known, 0.98)
        .when(sure, F.col("s.score") / 100)
        .when(partly, F.col("p.score") / 100)
        .when(F.col("s.score") >= config.suggestion_cut, F.col("s.score") / 100)
        .otherwise(0.0)
        .alias("match_confidence"),
    )
    out = out.withColumnsRenamed({"label": "__l", "scope": "__sc"})
    return rows.join(out, rows["label"].eqNullSafe(out["__l"]) & (rows["scope"] == out["__sc"]), "left").drop("form", "scope", "__l", "__sc")


# Letters that may have been lost, accents taken off, in the order in which they are tried.
LOST_LETTERS = "eaioucny"
#: Lost characters up to which every filling is looked up.
LOST_MOST = 2


def wildcard_join(labels: DataFrame, terms: DataFrame, label: str = "label", config: Config = DEFAULT) -> DataFrame:
    """(label, hits, best, confidence) of labels with lost characters.

    Up to two lost characters are filled with every letter and looked up, an equi-join: one term is sure (0.99); of two
    or three the one closest to the label without the lost characters is likely (0.80); of more the first is a guess
    (0.50). Without a hit, or with more lost characters, the label without them is matched by similarity, from 0.80 up
    where fillings were tried, and counts as one hit of 0.80 at most. What is left stays as it is (0.50).
    """
    lost = labels.filter(text.has_wildcard(F.col(label))).select(F.col(label).alias("label")).distinct()
    form = text.normalize(F.regexp_replace("label", "�", "?"))
    lost = lost.withColumns({"form": form, "n": F.length("label") - F.length(F.translate("label", "�?", "")), "stripped": F.translate("label", "�?", "")})
    filled = lost.filter(F.col("n") <= LOST_MOST).select("label", "form")
    for _ in range(LOST_MOST):
        letters = F.array(*[F.lit(c) for c in LOST_LETTERS])
        filled = filled.withColumn("c", F.explode(F.when(F.contains("form", F.lit("?")), letters).otherwise(F.array(F.lit("")))))
        filled = filled.withColumn("form", F.expr("case when c = '' then form else concat(substring_index(form, '?', 1), c, substring(form, locate('?', form) + 1)) end")).drop("c")
    index = term_index(terms).select("form", F.col("canonical"), "ord")
    rank = F.translate("form", LOST_LETTERS, "".join(chr(48 + i) for i in range(len(LOST_LETTERS))))
    hits = filled.join(dimension(index), "form").groupBy("label", "canonical", "ord").agg(F.min(rank).alias("rank"))
    hits = hits.join(lost.select("label", "stripped"), "label")
    ratio = similarity.indel_ratio(text.lexical_normal(text.normalize(F.col("canonical"))), text.lexical_normal(text.normalize(F.col("stripped"))))
    by = hits.withColumn("ratio", ratio).groupBy("label").agg(
        F.count("*").cast("int").alias("hits"), F.min_by("canonical", F.struct("rank", "ord")).alias("first"), F.min_by("canonical", F.struct(-F.col("ratio"), F.col("rank"), F.col("ord"))).alias("closest")
    )
    known = stored(lost.join(by, "label", "left"), "lost")
    near = fuzzy_match(known.filter("hits is null").select(F.col("stripped").alias("label")).distinct(), terms, config=config)
    near = near.filter(F.col("canonical").isNotNull()).select(F.col("label").alias("stripped"), F.col("canonical").alias("near"), F.col("match_confidence").alias("score"))
    out = known.join(near, "stripped", "left")
    close = F.col("near").isNotNull() & ((F.col("n") > LOST_MOST) | (F.col("score") >= 0.80))
    return out.select(
        F.col("label").alias(label),
        F.coalesce("hits", F.when(close, 1), F.lit(0)).cast("int").alias("hits"),
        F.when(F.col("hits").between(2, 3), F.col("closest")).when(F.col("hits").isNotNull(), F.col("first")).when(close, F.col("near")).otherwise(F.col("label")).alias("best"),
        F.when(F.col("hits") == 1, 0.99).when(F.col("hits") <= 3, 0.80).when(F.col("hits") > 3, 0.50).when(close, F.least(F.lit(0.80), F.col("score"))).otherwise(0.50).alias("confidence"),
    )


def nearest_word(words: DataFrame, vocabulary: DataFrame, reach: int = 2) -> DataFrame:
    """(word, match, distance): closest vocabulary word within reach edits.

    The join is on length bands; the threshold form of the distance stops early beyond the reach.
    """
    a = words.select(F.col("word")).distinct().withColumn("len", F.length("word"))
    b = vocabulary.select(F.col("word").alias("match"), "ord")
    bands = b.withColumn("len", F.explode(F.sequence(F.greatest(F.length("match") - reach, F.lit(1)), F.length("match") + reach)))
    near = a.join(dimension(bands), "len").withColumn("distance", F.levenshtein("word", "match", reach)).filter("distance >= 0")
    best = near.groupBy("word").agg(F.min(F.struct("distance", F.length("match").alias("n"), "ord", "match")).alias("m"))
    return best.select("word", "m.match", "m.distance")


def keyword_values(rows: DataFrame, keywords: DataFrame, keys) -> DataFrame:
    """(keys, figure, value): for each figure the value of the first row whose label, without accents, holds its first
    matching keyword."""
    given = rows.filter(F.col("value").isNotNull()).withColumn("low", text.strip_accents(F.trim(F.regexp_replace(F.lower("label"), r"\s+", " "))))
    hits = given.join(dimension(keywords), F.contains(F.col("low"), F.col("keyword")))
    return hits.groupBy(*keys, "figure").agg(F.min_by("value", F.struct("priority", "row_idx")).alias("value"))


def first_match(label: Column, words: list[tuple[str, str]]) -> Column:
    """The name beside the first keyword that the label holds."""
    return F.coalesce(*[F.when(F.contains(label, F.lit(k)), F.lit(v)) for k, v in words])


def classify_section(label: Column, sections: list[tuple[str, str]]) -> Column:
    """Section by its label, either containing the other, in order; then by key words."""
    form = text.normalize(label)
    named = [F.when((F.contains(form, F.lit(name)) | F.contains(F.lit(name), form)) & (form != ""), F.lit(key)) for key, name in sections]
    loose = first_match(form, SECTION_WORDS)
    return F.coalesce(*named, loose) if named else loose


# Looser section key words, in order.
SECTION_WORDS = [
    ("actifs non courants", "actifs_non_courants"), ("actif non courant", "actifs_non_courants"), ("actifs immobilises", "actifs_non_courants"),
    ("actif immobilise", "actifs_non_courants"), ("actifs courants", "actifs_courants"), ("actif courant", "actifs_courants"),
    ("capitaux propres", "capitaux_propres"), ("passifs non courants", "passifs_non_courants"), ("passif non courant", "passifs_non_courants"),
    ("passifs courants", "passifs_courants"), ("passif courant", "passifs_courants"),
]


def classify_statements(rows: DataFrame, keys, votes: str = "statement", boosters: dict | None = None) -> DataFrame:
    """(keys, label, confidence, strict): statement by term votes and structural boosters, ties in the order given.

    label needs no minimum, strict needs a score of 2; groups without any score are unknown.
    """
    low = F.lower(F.col("label"))
    def boost(words):
        return 3 * F.coalesce(F.max(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]).cast("int")), F.lit(0))

    score = {s: F.sum(F.coalesce((F.col(votes) == s).cast("int"), F.lit(0))) + reduce(lambda a, b: a + b, [boost(w) for w in words]) for s, words in (boosters or BOOSTERS).items()}
    names = list(score)
    by = rows.groupBy(*keys).agg(*[score[n].cast("double").alias(n) for n in names])
    top, total = F.greatest(*names), reduce(lambda a, b: a + b, [F.col(n) for n in names])
    winner = F.lit("unknown")
    for n in reversed(names):
        winner = F.when(F.col(n) == top, n).otherwise(winner)
    return by.select(
        *keys,
        F.when(total > 0, winner).otherwise("unknown").alias("label"),
        F.when(total > 0, F.least(F.lit(1.0), 1.2 * top / total)).otherwise(0.0).alias("confidence"),
        F.when(top >= 2, winner).otherwise("unknown").alias("strict"),
    )


# Key words that raise a statement's score by 3, each list once.
BOOSTERS = {
    "bilan": [
        ["brut", "amort", "amortissement", "dépréc", "deprec"],
        ["actifs non courants", "actifs courants", "actifs immobilis", "total des actifs", "total de l'actif", "total actif", "immobilisations incorporelles", "immobilisations corporelles"],
        ["capitaux propres", "passifs non courants", "passifs courants", "total des passifs", "total du passif", "total passif", "total des capitaux propres", "capital social", "capitaux propres et passifs"],
    ],
    "compte_resultat": [["résultat d'exploitation", "resultat d'exploitation", "produits d'exploitation", "charges d'exploitation", "charges de personnel", "achats consomm"]],
    "flux_tresorerie": [["flux de tr", "flux net", "trésorerie de clôture", "tresorerie de cloture", "activités d'exploitation", "activités d'investissement", "activités de financement"]],
}


def segments(rows: DataFrame, keys) -> DataFrame:
    """(keys, statement, confidence, hits) of tables of matched labels (label, match_type, statement): the strict class,
    and the share of labels that a term matched plus 0.2, at most 1; 0 where the class is unknown."""
    keys = list(keys)
    matched = F.col("match_type").isin("exact", "fuzzy", "resolved")
    voted = rows.withColumn("statement", F.when(matched, F.col("statement")))
    share = rows.filter(F.trim("label") != "").groupBy(*keys).agg(F.count_if(matched).alias("hits"), F.count("*").alias("n"))
    out = classify_statements(voted, keys).join(share, keys, "left")
    confidence = F.when(F.col("strict") == "unknown", 0.0).otherwise(F.least(F.lit(1.0), F.col("hits") / F.greatest(F.col("n"), F.lit(1)) + 0.2))
    return out.select(*keys, F.col("strict").alias("statement"), confidence.alias("confidence"), F.coalesce("hits", F.lit(0)).alias("hits"))


def segment_sides(rows: DataFrame, keys, actif: list[str], passif: list[str]) -> DataFrame:
    """(keys, side): a balance sheet's side by the key words that its labels hold, each once; both sides from three each,
    one from two against at most one."""
    form = text.normalize(F.col("label"))
    count = lambda words: reduce(lambda a, b: a + b, [F.max(F.coalesce(F.contains(form, F.lit(w)), F.lit(False)).cast("int")) for w in words])
    by = rows.groupBy(*keys).agg(count(actif).alias("a"), count(passif).alias("p"))
    side = F.when((F.col("a") >= 3) & (F.col("p") >= 3), F.lit(None)).when((F.col("a") >= 2) & (F.col("p") <= 1), "actif").when((F.col("p") >= 2) & (F.col("a") <= 1), "passif")
    return by.select(*keys, side.cast("string").alias("side"))


def side_memberships(segments: DataFrame) -> DataFrame:
    """Segments by bucket: each in its statement's, and in its side's besides."""
    extra = segments.filter(F.col("side").isNotNull()).withColumn("bucket", F.concat_ws("_", "statement", "side"))
    return segments.withColumn("bucket", F.col("statement")).unionByName(extra)
