"""Locale-formatted numbers as column expressions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,6)"
# Glyphs that scanners confuse with digits, and the digits.
CONFUSED, DIGITS = "OolISB", "001158"
CURRENCY = r"(?i)(?:DT|TND|EUR|USD|€|\$|DH|MAD)"
_SPACES = "   "


def fix_confused_digits(c: Column) -> Column:
    """Confused glyphs to digits where the whole token reads as a number and shows a sure digit or a separator."""
    numeric = c.rlike(r"^[\d.,\s()OolISB   ‑–—\-+]+$")
    sure = c.rlike("[2-9]") | c.rlike(r"[.,\s]")
    return F.when(numeric & sure, F.translate(c, CONFUSED, DIGITS)).otherwise(c)


def normalize_locale(c: Column) -> Column:
    """Lone dashes to 0, parentheses to a minus sign; hard spaces and currency marks go."""
    s = F.trim(c)
    s = F.when(s.rlike(r"^[\-–—‑]+$"), F.lit("0")).otherwise(F.regexp_replace(s, r"^\(\s*(.+?)\s*\)$", "-$1"))
    s = F.translate(s, _SPACES, "")
    s = F.regexp_replace(s, rf"^\s*{CURRENCY}\s+", "")
    return F.trim(F.regexp_replace(s, rf"\s*{CURRENCY}\s*$", ""))


def parse_french(c: Column) -> Column:
    """1 500,00 / 1.500,00 / (1.500) / - / 150,00 DT to decimal; NULL where no number can be read."""
    text = F.trim(c.cast("string"))
    s = F.replace(normalize_locale(fix_confused_digits(text)), F.lit(" "), F.lit(""))
    dots, commas = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
    plain = (
        F.when(dots & commas, F.translate(F.translate(s, ".", ""), ",", "."))
        .when(commas, F.translate(s, ",", "."))
        .when(s.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.translate(s, ".", ""))
        .otherwise(s)
    )
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast(DECIMAL))


def is_numeric(c: Column) -> Column:
    return parse_french(c).isNotNull()


def extract_numeric(c: Column) -> Column:
    """Lenient reading for validation: junk around the digits goes, two numbers in one cell are refused."""
    s = F.trim(c.cast("string"))
    garbled = s.rlike(r"\d{1,3}(?:,\d{3})+\s+\d{1,3}(?:,\d{3})+")
    t = F.translate(s, "  ", "")
    t = F.when(t.startswith("(") & t.endswith(")"), F.concat(F.lit("-"), F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t)
    t = F.regexp_replace(t, r"[^\d\-.,]", "")
    dots, commas = F.contains(t, F.lit(".")), F.contains(t, F.lit(","))
    t = F.when(commas & ~dots, F.translate(t, ",", ".")).when(commas & dots, F.translate(t, ",", "")).otherwise(t)
    return F.when(~garbled & t.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))


def within(a: Column, b: Column, base: Column | None = None, relative: float = 0.01, absolute: float = 1.0) -> Column:
    """|a - b| <= max(|base| x relative, absolute)."""
    return F.abs(a - b) <= F.greatest(F.abs(a if base is None else base) * F.lit(relative), F.lit(absolute))


def grade_to_score(c: Column) -> Column:
    return F.when(c == "EXCELLENT", 1.0).when(c == "GOOD", 0.80).when(c == "POOR", 0.25).otherwise(0.55)


def score_to_grade(c: Column) -> Column:
    return F.when(c >= 0.85, "EXCELLENT").when(c >= 0.65, "GOOD").when(c >= 0.40, "FAIR").otherwise("POOR")


def percent(c: Column) -> Column:
    """Share to whole percent, halves to even."""
    return F.bround(c * 100, 0).cast("int")


def five_scores(weights: list[tuple[Column, float]]) -> Column:
    """Weighted mean of scores, weights normalized."""
    total = sum(w for _, w in weights)
    return sum((c * F.lit(w / total) for c, w in weights), F.lit(0.0))


def column_value(c: Column, dots_are_noise: Column) -> Column:
    """Reading of a cell of a column in which dots were found to be noise."""
    s = F.trim(c.cast("string"))
    noisy = dots_are_noise & F.contains(s, F.lit(".")) & ~F.contains(s, F.lit(","))
    return F.when(noisy, extract_numeric(F.translate(s, ".", ""))).otherwise(extract_numeric(c))


def variation(current: Column, prior: Column) -> Column:
    """Change in percent of the prior value; NULL without a base."""
    return F.try_divide(current - prior, F.abs(prior)) * 100


def french_percent(c: Column) -> Column:
    """+12,0% in French form."""
    return F.concat(F.translate(F.format_string("%+.1f", c.cast("double")), ".", ","), F.lit("%"))
