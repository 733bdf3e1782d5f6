"""Repair of scanned text: dictionary words, word breaks, line-wise resolution, and what was corrected.

Corrections are worked out once for each distinct token, in Arrow batches over a broadcast vocabulary of counted size,
and joined back; the rest are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.similarity import break_words, nearest
from ..functions.text import ACCENTED, PLAIN

#: Words that a vocabulary may have.
VOCABULARY = 200_000
# Patterns of the counted categories.
SIGN, GLYPH, CAMEL, LOST, RULE = r"(^|\s)[=:_~]\d", r"\d[OolISB]\d", "[a-zà-ÿ][A-ZÀ-Ý][a-zà-ÿ]", "�", r"_{3,}"


class Vocabulary:
    """Normal forms with their display forms."""

    def __init__(self, words: list[str]):
        self.display: dict[str, str] = {}
        for w in words:
            self.display.setdefault(self.normal(w), w)
        self.words = frozenset(self.display)
        self.by_length: dict[int, list[str]] = {}
        for w in self.display:
            self.by_length.setdefault(len(w), []).append(w)
        self.longest = max(map(len, self.display), default=0)

    @staticmethod
    def normal(word: str) -> str:
        table = str.maketrans(ACCENTED, PLAIN)
        return word.lower().translate(table).upper()

    def breaks(self, joined: str, reach: int = 1) -> list[str] | None:
        """Words that spell joined: exact ones if possible, else of least total distance, then fewest."""
        exact = break_words(joined, self.words, self.longest)
        if exact is not None:
            return exact
        best: list[tuple[int, int, list[str]] | None] = [(0, 0, [])] + [None] * len(joined)
        for end in range(1, len(joined) + 1):
            for begin in range(max(0, end - self.longest - reach), end - 1):
                if best[begin] is None:
                    continue
                piece = joined[begin:end]
                hit = (piece, 0) if piece in self.words else nearest(piece, self.by_length, reach)
                if hit:
                    d, n, words = best[begin]
                    new = (d + hit[1], n + 1, words + [hit[0]])
                    if best[end] is None or new[:2] < best[end][:2]:
                        best[end] = new
        return best[-1][2] if best[-1] else None

    def correct(self, word: str) -> str:
        """A token corrected: known words get their accents, short ones one edit, long ones are broken or get two edits."""
        lead = len(word) - len(word.lstrip("".join(c for c in set(word) if not c.isalpha())))
        core = word[lead:]
        tail = len(core) - len(core.rstrip("".join(c for c in set(core) if not c.isalpha())))
        end, core = (core[len(core) - tail :], core[: len(core) - tail]) if tail else ("", core)
        if not core:
            return word
        form = self.normal(core)
        if form in self.words:
            found = [form]
        elif len(form) <= 4:
            hit = nearest(form, self.by_length, 1)
            found = [hit[0]] if hit else None
        else:
            found = self.breaks(form)
            if found is None:
                hit = nearest(form, self.by_length, 2)
                found = [hit[0]] if hit else None
        if found is None:
            return word
        return word[:lead] + in_case(" ".join(self.display[f] for f in found), core) + end


def in_case(words: str, model: str) -> str:
    if model.isupper():
        return words.upper()
    if model.islower():
        return words.lower()
    return words[:1].upper() + words[1:].lower() if model[:1].isupper() else words


def correct_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, corrected) of distinct tokens; vocabulary (word) of at most VOCABULARY words."""
    words = [r["word"] for r in vocabulary.select("word").limit(VOCABULARY + 1).collect()]
    if len(words) > VOCABULARY:
        raise ValueError(f"the vocabulary has more than {VOCABULARY} words")
    shared = tokens.sparkSession.sparkContext.broadcast(sorted(words))

    @F.pandas_udf(T.StringType())
    def corrected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Vocabulary(shared.value)
        for batch in batches:
            yield pd.Series([None if w is None else known.correct(w) for w in batch], dtype=object)

    return tokens.select("token").distinct().withColumn("corrected", corrected("token"))


def correct_phrases(rows: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """rows with the column's words corrected; numbers stay, white space collapses to blanks; changed tells which rows."""
    numeric = F.col(column).rlike(text.NUMERIC_CLASS)
    phrases = rows.select(F.col(column).alias("__phrase")).filter(F.col("__phrase").isNotNull() & ~F.col("__phrase").rlike(text.NUMERIC_CLASS)).distinct()
    tokens = phrases.select("__phrase", F.posexplode(F.split(F.trim(F.regexp_replace("__phrase", r"\s+", " ")), " ")).alias("pos", "token"))
    fixed = tokens.join(correct_tokens(tokens, vocabulary), "token")
    joined = fixed.groupBy("__phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "corrected"))), lambda x: x["corrected"]), " ").alias("__fixed"))
    out = rows.join(joined, rows[column] == joined["__phrase"], "left")
    value = F.when(numeric | F.col("__fixed").isNull(), F.col(column)).otherwise(F.col("__fixed"))
    return out.withColumn("changed", ~value.eqNullSafe(F.col(column))).withColumn(column, value).drop("__phrase", "__fixed")


def resolve_lines(docs: DataFrame, resolved: DataFrame, sure: float = 0.80) -> DataFrame:
    """Texts whose lines with lost characters are replaced by their resolution (label, best, confidence) from sure on."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = resolved.filter(F.col("confidence") >= sure).select(F.col("label").alias("line"), "best")
    merged = lines.join(found, "line", "left").withColumn("line", F.coalesce("best", "line"))
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return merged.groupBy("doc_id").agg(text_.alias("text"))


def repaired(c: Column, terms: list[tuple[str, str]] = ()) -> Column:
    """All column repairs in order: terms, joined words, number formats, punctuation."""
    return text.smart_punctuation(text.numeric_format_repair(text.split_camel(text.replace_terms(c, list(terms)))))


# Terms to split where no dictionary can be read.
FALLBACK_TERMS = (
    ("TOTALACTIF", "TOTAL ACTIF"),
    ("TOTALPASSIF", "TOTAL PASSIF"),
    ("CAPITAUXPROPRES", "CAPITAUX PROPRES"),
    ("RESULTATNET", "RÉSULTAT NET"),
    ("CHIFFREDAFFAIRES", "CHIFFRE D'AFFAIRES"),
)
# What is counted and rewritten, in order: (category, pattern, replacement). A sign or letter counts on the
# text that the rewriting before it left. Java reads $10 as group 1 and a 0 where there are two groups, and takes no ${1}.
REWRITES = (
    ("camel", "([a-zéèêëàâäùûüîïôöç])([A-ZÉÈÊËÀÂÄÙÛÜÎÏÔÖÇ])", "$1 $2"),
    ("space", "([a-zéèêëàâäùûüîïôöç]{2,})([A-ZÉÈÊËÀÂÄÙÛÜÎÏÔÖÇ][a-zéèêëàâäùûüîïôöç]+)", "$1 $2"),
    ("sign", r"(?m)^=(\d)", "-$1"), ("sign", r"\s=(\d)", " -$1"), ("sign", r"(?m)^:(\d)", "-$1"), ("sign", r"\s:(\d)", " -$1"), ("sign", r"(?m)^_(\d)", "-$1"), ("sign", r"\s_(\d)", " -$1"),
    *(("glyph", rf"(\d){glyph}(\d)", f"$1{digit}$2") for glyph, digit in zip("OolISB", "001158")),
)


def correction_counts(docs: DataFrame, column: str = "text", terms=FALLBACK_TERMS) -> DataFrame:
    """docs with the column rewritten step by step and n_terms, n_camel, n_space, n_sign, n_glyph, n_corrections.

    Every step counts on the text that the step before it left. Each level stands behind a one-row generator, so that a
    text is rewritten once.
    """
    from ..functions.columns import computed_once

    out, total = computed_once(docs, "__t", F.struct(F.coalesce(F.col(column), F.lit("")).alias("t"), *[F.lit(0).cast("long").alias(c) for c in ("terms", "camel", "space", "sign", "glyph")])), []
    steps = [("terms", "(?i)" + re.escape(wrong), right) for wrong, right in terms] + list(REWRITES)
    for category, pattern, right in steps:
        fixed = F.regexp_replace(F.col("__t.t"), pattern, right)
        counts = [(F.col(f"__t.{c}") + (F.regexp_count(F.col("__t.t"), F.lit(pattern)) if c == category else F.lit(0))).alias(c) for c in ("terms", "camel", "space", "sign", "glyph")]
        out = computed_once(out, "__t", F.struct(fixed.alias("t"), *counts))
    total = sum((F.col(f"__t.{c}") for c in ("terms", "camel", "space", "sign", "glyph")), F.lit(0))
    names = {f"n_{c}": F.col(f"__t.{c}") for c in ("terms", "camel", "space", "sign", "glyph")}
    return out.withColumns({**names, "n_corrections": total, column: F.col("__t.t")}).drop("__t")
