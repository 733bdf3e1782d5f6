"""Text repair and normal forms as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters of French and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
NUMERIC_CLASS = r"^[\d\s.,()—–\-€DT]+$"


def strip_accents(c: Column) -> Column:
    return F.translate(F.translate(c, ACCENTED, PLAIN), ACCENTED.upper().replace("SS", "ß"), PLAIN.upper())


def normalize(c: Column) -> Column:
    """Lower-case, no accents, apostrophes and ampersands to blanks, blanks collapsed."""
    s = F.translate(F.lower(c), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(s, r"['’‘`&\s ]+", " "))


def normalize_upper(c: Column) -> Column:
    return F.upper(F.translate(F.lower(c), ACCENTED, PLAIN))


def numeric_format_repair(c: Column) -> Column:
    """Signs misread before digits, then letters misread between digits (one pass each)."""
    s = F.regexp_replace(c, r"(^|\s)[=:_~](\d)", "$1-$2")
    for glyph, digit in (("O", "0"), ("o", "0"), ("l", "1"), ("I", "1"), ("S", "5"), ("B", "8")):
        s = F.regexp_replace(s, rf"(\d){glyph}(\d)", f"$1{digit}$2")
    return s


def smart_punctuation(c: Column) -> Column:
    """Typographic quotes, dashes and ellipses to plain ones; runs of blanks to one."""
    s = F.translate(c, "‘’“”–— ", "''\"\"-- ")
    s = F.regexp_replace(s, "…", "...")
    return F.regexp_replace(s, "[ \t]{2,}", " ")


def split_camel(c: Column) -> Column:
    """A blank between a lower-case and an upper-case letter that opens a word."""
    return F.regexp_replace(c, r"([a-zà-ÿ])([A-ZÀ-Ý][a-zà-ÿ])", "$1 $2")


def replace_terms(c: Column, terms: list[tuple[str, str]]) -> Column:
    """Literal term corrections, one after another."""
    return reduce(lambda s, t: F.replace(s, F.lit(t[0]), F.lit(t[1])), terms, c)


def match_case(c: Column, model: Column) -> Column:
    """c in the case of model: all upper, all lower, capitalized, or unchanged."""
    return (
        F.when((model == F.upper(model)) & (model != F.lower(model)), F.upper(c))
        .when(model == F.lower(model), F.lower(c))
        .when(model == F.initcap(model), F.initcap(c))
        .otherwise(c)
    )


def is_caps_heading(c: Column) -> Column:
    """Capital letters and blanks only, three characters at least."""
    return (F.char_length(F.trim(c)) >= 3) & F.trim(c).rlike(r"^[A-ZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜ\s\-'’.,()]+$") & c.rlike("[A-Z]")


def has_digit(c: Column) -> Column:
    return c.rlike(r"\d")


def has_wildcard(c: Column) -> Column:
    """A lost character (U+FFFD or ?) in a label of at most 120 characters."""
    return c.rlike("[�?]") & (F.char_length(c) <= 120)


def wildcard_pattern(c: Column) -> Column:
    """Regular expression over normal forms in which each lost character may be any letter an accent falls on."""
    quoted = F.regexp_replace(c, r"([\\.\[\]{}()*+^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, "[�?]", "[eaiouycn]"), F.lit("$"))


def lexical_normal(c: Column) -> Column:
    """Letters and digits only, for similarity: other characters to blanks, lower-case, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", " "), " +", " "))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(lexical_normal(c), " ")), " ")


def garbled_cell(c: Column) -> Column:
    """Two numbers in one cell."""
    return c.rlike(r"\d[\d\s.,]{3,}\s+\d[\d\s.,]{3,}")
