"""Quality rules as a short-circuit cascade (native: SQL functions only).

Rules are data: a name, the features they read and the condition under which a text fails. On a bounded random sample
(the rows of smallest id hash) every rule's verdict is taken once; its cost is what its features cost on the sample's
texts, by unit costs per character, word and line, where features that earlier rules have read are free. The next rule
is always the one with the most rejections per cost among the rows that the rules before it left. The order never
changes a verdict: a text is kept if no rule rejects it, and the plan is the same on every run.

`keep` runs the cascade as filters, each behind the features it needs, so that a rejected row costs the later rules
nothing. `assess` returns all base counts of every row; what only the verdict needs is computed in the branches of one
conditional, so it is not computed for rows that an earlier rule has rejected.

Defined results: a null or empty text has no words and fails `few_words`; very long texts are read whole; rows are
judged one by one, so repeated rows get equal verdicts; a column named like an internal one (`__q_...`) is carried and
never read; an empty table gives an empty table; further columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, once

_RX = WORD.replace("\\", "\\\\")
_P = "__q_"

#: Expressions over the text column `__q_text` and over each other, in order of need.
FEATURES: dict[str, str] = {
    "words": f"regexp_extract_all(__q_text, '{_RX}', 0)",
    "lines": "filter(split(__q_text, '\\n', -1), x -> rlike(x, '[^\\\\x20\\\\x09-\\\\x0D]'))",
    "n_words": "cast(size(__q_words) as bigint)",
    "word_chars": "cast(char_length(array_join(__q_words, '')) as bigint)",
    "n_symbols": "cast(regexp_count(__q_text, '[#*$%&|<>]') as bigint)",
    "n_dup_lines": "cast(size(__q_lines) - size(array_distinct(__q_lines)) as bigint)",
    "n_lines": "cast(size(__q_lines) as bigint)",
    # hashes of the 3-word windows; texts without equal hashes have no repeated window
    "windows": "case when size(__q_words) < 3 then cast(array() as array<bigint>) else "
    "transform(sequence(0, size(__q_words) - 3), i -> xxhash64(__q_words[i], __q_words[i + 1], __q_words[i + 2])) end",
    # windows whose leading hash bits recur, in hash order: 36 bits of hash, then the position in 28 bits
    "packed": "case when size(array_distinct(__q_windows)) = size(__q_windows) then cast(array() as array<bigint>) else "
    "sort_array(transform(__q_windows, (h, i) -> shiftleft(h, 28) | cast(i as bigint))) end",
    "suspects": "transform(filter(__q_packed, (x, i) -> "
    "(i > 0 and shiftright(x, 28) = shiftright(__q_packed[greatest(i - 1, 0)], 28)) or "
    "(i < size(__q_packed) - 1 and shiftright(x, 28) = shiftright(__q_packed[least(i + 1, size(__q_packed) - 1)], 28))), "
    "x -> cast(x & 268435455L as int))",
    # the words themselves decide
    "exact": "sort_array(transform(__q_suspects, i -> struct(concat_ws(' ', __q_words[i], __q_words[i + 1], __q_words[i + 2]) as g, i as i)))",
    "repeated": "sort_array(transform(filter(__q_exact, (x, i) -> "
    "(i > 0 and x.g = __q_exact[greatest(i - 1, 0)].g) or "
    "(i < size(__q_exact) - 1 and x.g = __q_exact[least(i + 1, size(__q_exact) - 1)].g)), x -> x.i))",
    "n_repeat_words": "cast(aggregate(__q_repeated, named_struct('n', 0, 'last', -3), "
    "(a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n) as bigint)",
    "all_caps": "lower(__q_text) <> __q_text and upper(__q_text) = __q_text",
    "n_lorem": "cast(regexp_count(__q_text, '(?i)lorem ipsum') as bigint)",
    "n_ellipsis": "cast(regexp_count(__q_text, '(?:\\\\.\\\\.\\\\.|…)[\\\\x20\\\\x09\\\\x0B-\\\\x0D]*+(?=\\n|\\\\z)') as bigint)",
    "n_bullets": "cast(regexp_count(__q_text, '(?:\\\\A|\\n)[\\\\x20\\\\x09\\\\x0B-\\\\x0D]*+[-*•]') as bigint)",
    # a letter and the rest of its word
    "n_alphabetic": "cast(regexp_count(__q_text, '[A-Za-z\\\\x{80}-\\\\x{10FFFF}][^\\\\x20\\\\x09-\\\\x0D]*+') as bigint)",
}
#: Unit costs: what a feature takes per character, word and line of a text, in nanoseconds (measured, one core).
COSTS: dict[str, tuple[float, float, float]] = {
    "words": (4, 70, 0), "lines": (1, 0, 120), "word_chars": (1, 10, 0), "n_symbols": (5, 0, 0), "n_dup_lines": (0, 0, 60), "windows": (0, 90, 0),
    "packed": (0, 60, 0), "suspects": (0, 5, 0), "exact": (0, 5, 0), "repeated": (0, 5, 0), "n_repeat_words": (0, 2, 0), "all_caps": (4, 0, 0),
    "n_lorem": (4, 0, 0), "n_ellipsis": (4, 0, 0), "n_bullets": (4, 0, 10), "n_alphabetic": (6, 10, 0),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    fails: str


BASE = (
    Rule("few_words", ("words", "n_words"), "__q_n_words < 50"),
    Rule("repeated_words", ("words", "n_words", "windows", "packed", "suspects", "exact", "repeated", "n_repeat_words"), "100 * __q_n_repeat_words > 50 * __q_n_words"),
)
FURTHER = (
    Rule("symbols", ("words", "n_words", "n_symbols"), "10 * __q_n_symbols > __q_n_words"),
    Rule("repeated_lines", ("lines", "n_dup_lines", "n_lines"), "2 * __q_n_dup_lines > __q_n_lines"),
    Rule("all_caps", ("all_caps",), "__q_all_caps"),
    Rule("word_length", ("words", "n_words", "word_chars"), "__q_word_chars < 2 * __q_n_words or __q_word_chars > 20 * __q_n_words"),
    Rule("lorem", ("n_lorem",), "__q_n_lorem > 0"),
    Rule("ellipses", ("lines", "n_lines", "n_ellipsis"), "__q_n_lines >= 4 and 10 * __q_n_ellipsis > 3 * __q_n_lines"),
    Rule("bullets", ("lines", "n_lines", "n_bullets"), "__q_n_lines >= 4 and 10 * __q_n_bullets > 9 * __q_n_lines"),
    Rule("alphabetic", ("words", "n_words", "n_alphabetic"), "2 * __q_n_alphabetic < __q_n_words"),
)
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 400


#: Features that are arrays; they are computed once a row, also where later filters use them.
_ARRAYS = frozenset(["words", "lines", "windows", "packed", "suspects", "exact", "repeated"])


def with_features(docs: DataFrame, names, text: str = "text", given: bool = False) -> DataFrame:
    """docs and the named features as __q_ columns; given: docs come from here and have __q_text."""
    out = docs if given else docs.withColumn(_P + "text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    for n, value in FEATURES.items():
        if n in names:
            out = once(out, _P + n, value) if n in _ARRAYS else out.withColumn(_P + n, F.expr(value))
    return out


def _sample(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """Texts of the rows of smallest id hash: found on the id column alone, so that only their pages of text are read."""
    if "doc_id" not in docs.columns:
        return docs.select(F.col(text).alias("text")).limit(rows)
    chosen = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = [r["doc_id"] for r in chosen.collect()]  # at most `rows` of them
    picked = docs.filter(F.col("doc_id").isin(ids)) if ids else docs
    return picked.select(F.col(text).alias("text")).limit(rows)


def plan_cascade(docs: DataFrame, rules=BASE + FURTHER, text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost per row in nanoseconds, share it rejects of the rows left) in the order in which the rules should run."""
    names = {n for r in rules for n in r.needs} | {"words", "lines"}
    judged = with_features(_sample(docs, text, rows), names)
    units = [F.char_length(_P + "text").alias("chars"), F.size(_P + "words").alias("words"), F.size(_P + "lines").alias("lines")]
    seen = judged.select(*units, *[F.coalesce(F.expr(r.fails), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    n = max(len(seen), 1)
    mean = [sum(row[u] for row in seen) / n for u in ("chars", "words", "lines")]
    price = lambda f: sum(c * m for c, m in zip(COSTS.get(f, (0, 0, 0)), mean)) + 1
    left, have, open_, out = seen, set(), list(range(len(rules))), []
    while open_:
        def worth(i: int) -> tuple[float, float, int]:
            cost = sum(price(f) for f in rules[i].needs if f not in have) + 1  # noqa: B023
            return sum(row[f"r{i}"] for row in left) / max(len(left), 1) / cost, -cost, -i  # noqa: B023

        best = max(open_, key=worth)
        share, cost, _ = worth(best)
        out.append((rules[best], -cost, share * -cost))
        have |= set(rules[best].needs)
        left = [row for row in left if not row[f"r{best}"]]
        open_.remove(best)
    return out


#: Features that every row has in the result of `assess`.
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    These counts are results, so they are computed for every row; the features of further rules only where no rule
    before has rejected the row: a conditional's later branches are not evaluated.
    """
    order = [rule for rule, _, _ in plan_cascade(docs, FURTHER, text)]
    verdict = F.expr("__q_n_words < 50 or 100 * __q_n_repeat_words > 50 * __q_n_words")
    always = {n for r in BASE + FURTHER for n in r.needs if n in {*_COUNTS, *_ARRAYS, "n_lines"}}
    rejected = F.when(verdict, True)
    for rule in order:
        condition = rule.fails
        for n in rule.needs:
            if n not in always:
                condition = condition.replace(_P + n, f"({FEATURES[n]})")
        rejected = rejected.when(F.expr(condition), True)
    passing = [c for c in docs.columns if c not in {*_COUNTS, "base_failed", "kept"}]
    carried = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(passing)]
    kept = with_features(docs.select(*carried, F.col(f"`{text}`").alias("text")), always)
    return kept.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(passing)], *[F.col(_P + c).alias(c) for c in _COUNTS], verdict.alias("base_failed"), (~rejected.otherwise(False)).alias("kept"))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, columns unchanged.

    Each rule is a filter behind the features it needs, in the order of the cascade: a row that one rule rejects
    costs the later ones nothing.
    """
    out, have = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(docs.columns)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(_P + "text")), set()
    for rule, _, _ in plan_cascade(docs, text=text):
        new = [n for n in rule.needs if n not in have]
        have |= set(new)
        out = with_features(out, new, given=True).filter(~F.expr(rule.fails))
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])
