"""Projections, filters and predicates over the long cell table and the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text

TABLE = ("doc_id", "source", "table_idx")

# Key words of row types.
ASSET = "actif assets immobilisation stock créance disponibilité".split()
LIABILITY = "passif liabilities dette fournisseur emprunt provision".split()
EQUITY = ("capitaux propres", "equity", "capital social", "réserve", "résultat", "report à nouveau")
TOTAL = ("total", "somme")  # sub-totals contain the first
# Accepted uploads.
EXTENSIONS, UPLOAD_CAP = ("pdf", "docx", "jpg", "jpeg", "png", "tiff", "bmp"), 25 * 1024 * 1024


def drop_small_tables(cells: DataFrame, rows: int = 3) -> DataFrame:
    """Cells of tables with at least so many rows."""
    kept = cells.groupBy(*TABLE).agg(F.countDistinct("row_idx").alias("n")).filter(F.col("n") >= rows).select(*TABLE)
    return cells.join(kept, list(TABLE), "left_semi")


def garbled_tables(cells: DataFrame, share: float = 0.2) -> DataFrame:
    """(table, garbled): under two columns, or more than a fifth of the filled cells right of the label hold two numbers."""
    filled = (F.col("col_idx") > 0) & (F.trim("raw_value") != "")
    return cells.groupBy(*TABLE).agg(
        ((F.countDistinct("col_idx") < 2) | F.coalesce(F.avg(F.when(filled, text.garbled_cell(F.col("raw_value")).cast("int"))) > share, F.lit(False))).alias("garbled")
    )


def _any(label: Column, words) -> Column:
    return label.rlike("|".join(words))


def row_type(label: Column) -> Column:
    """Kind of a statement row by its label: totals first, then asset, liability, equity."""
    low = F.lower(label)
    asset, liability, equity, total = (_any(low, w) for w in (ASSET, LIABILITY, EQUITY, TOTAL))
    return (
        F.when(total & equity & liability, "total_equity_and_liabilities")
        .when(total & asset, "total_asset")
        .when(total & liability, "total_liability")
        .when(total & equity, "total_equity")
        .when(total, "total")
        .when(asset, "asset")
        .when(liability, "liability")
        .when(equity, "equity")
        .otherwise("other")
    )


def numeric_columns(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """(table, col_idx, ratio): columns of which more than half of the filled cells are numbers."""
    filled = cells.filter(F.col("raw_value").isNotNull() & (F.trim("raw_value") != ""))
    by = filled.groupBy(*TABLE, "col_idx").agg(F.avg(numbers.extract_numeric(F.col("raw_value")).isNotNull().cast("int")).alias("ratio"))
    return by.filter(F.col("ratio") > share)


def numeric_looking_columns(cells: DataFrame, share: float = 0.4) -> DataFrame:
    """As numeric_columns by the look of the cells; blanks count as cells."""
    given = cells.filter(F.col("raw_value").isNotNull())
    by = given.groupBy(*TABLE, "col_idx").agg(F.avg(F.trim("raw_value").rlike(text.NUMERIC_CLASS).cast("int")).alias("ratio"))
    return by.filter(F.col("ratio") >= share)


def subtotal(label: Column, known: Column) -> Column:
    """Subtotal by dictionary flag, by opening words, or by the bare word total."""
    low = F.trim(F.lower(label))
    return F.coalesce(known, F.lit(False)) | low.rlike(r"^(total\s+des?|sous[\s-]total|totaux)\b") | (low == "total")


def gate_status(category: Column, confidence: Column, cut: float = 0.70) -> Column:
    """Unclassified or uncertain documents are rejected."""
    return F.when((category == "Autre") | (confidence < cut), "REJECTED").otherwise("ACCEPTED")


def classification_gate(docs: DataFrame, cut: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) for different sinks; rejected ones get tier -1 and their status."""
    status = gate_status(F.col("category"), F.col("confidence"), cut)
    rejected = docs.filter(status == "REJECTED").withColumns({"tier": F.lit(-1), "status": F.lit("REJECTED")})
    return docs.filter(status == "ACCEPTED"), rejected


def upload_status(files: DataFrame) -> DataFrame:
    """files (filename, length) with status 415, 413 or 202."""
    ext = F.lower(F.regexp_extract("filename", r"\.(\w+)$", 1))
    return files.withColumn("status", F.when(~ext.isin(*EXTENSIONS), 415).when(F.col("length") > UPLOAD_CAP, 413).otherwise(202))


def idempotent(rows: DataFrame, keys=("org_id", "idempotency_key"), order: str = "created_at") -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    keyed = rows.filter(F.col(keys[-1]).isNotNull())
    first = keyed.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return rows.filter(F.col(keys[-1]).isNull()).unionByName(first)


def of_tenant(rows: DataFrame, org) -> DataFrame:
    return rows.filter(F.col("org_id") == org)


# Networks that no request may reach, as (first address, length of the prefix): version 4, then 6.
PRIVATE_4 = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))
PRIVATE_6 = r"^(::1?$|::ffff:|64:ff9b:1:|100:0*:0*:0*:|100::|2001:0{0,4}[:0-9a-f]*|2001:db8:|2002:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|[0-9a-f]{0,3}:)"


def _number_4(address: str) -> int:
    return sum(int(x) << 8 * (3 - i) for i, x in enumerate(address.split(".")))


def url_allowed(url: Column) -> Column:
    """Targets of http and https that are no private, loopback, link-local, reserved or multicast address, of version 4
    or 6, no localhost and no name of an internal zone. NULL for NULL."""
    rest = F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)
    place = F.lower(F.regexp_replace(rest, r"^.*@", ""))
    six = F.regexp_extract(place, r"^\[([0-9a-f:.]*)(?:%[^\]]*)?\](?::[0-9]*)?$", 1)
    host = F.when(place.startswith("["), six).otherwise(F.regexp_replace(place, r":[0-9]*$", ""))
    is_4 = host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    parts = F.split(host, r"\.")
    number = F.when(is_4, sum((F.get(parts, F.lit(i)).try_cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0)))
    private_4 = F.lit(False)
    for first, length in PRIVATE_4:
        low = _number_4(first)
        private_4 = private_4 | number.between(low, low + (1 << 32 - length) - 1)
    private = F.when(place.startswith("["), (six == "") | six.rlike(PRIVATE_6)).when(is_4, private_4).otherwise(host.isin("localhost") | host.endswith(".internal") | host.endswith(".local"))
    return F.when(url.isNotNull(), F.coalesce((host != "") & ~private, F.lit(False)))


def non_green(cells: DataFrame) -> DataFrame:
    """Cells whose flag asks for review."""
    return cells.filter(F.col("flag").isNotNull() & (F.col("flag") != "green"))


def scopes_of(roles: Column, superuser: Column, by_role: dict[str, list[str]]) -> Column:
    """Scopes of a role; all scopes for superusers."""
    every = F.array(*[F.lit(s) for s in sorted({s for v in by_role.values() for s in v})])
    own = F.lit(None).cast("array<string>")
    for role, scopes in by_role.items():
        own = F.when(roles == role, F.array(*[F.lit(s) for s in scopes])).otherwise(own)
    return F.when(superuser, every).otherwise(F.coalesce(own, F.array().cast("array<string>")))


def has_scopes(held: Column, needed: Column) -> Column:
    return F.size(F.array_except(needed, held)) == 0


def missing_scopes(held: Column, needed: Column) -> Column:
    return F.array_sort(F.array_except(needed, held))


def live_key(prefix: Column, wanted: Column, active: Column, expires: Column, now: Column) -> Column:
    """An API key that may be used: prefix, active, not expired."""
    return (prefix == wanted) & active & (expires.isNull() | (expires > now))


def all_present(items: Column, test) -> Column:
    """A non-empty array all of whose items pass."""
    return (F.size(items) > 0) & F.forall(items, test)


def schema_failures(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, check) for every row and failed check; a NULL verdict fails."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.select(key, F.explode(F.array_compact(failed)).alias("check"))


# Kinds of document by the schema that checks them; others are checked as balance sheets.
SCHEMAS = {"bilan": "balance_sheet", "balance_sheet": "balance_sheet", "compte_resultat": "income_statement", "income_statement": "income_statement"}


def schema_of(kind: Column) -> Column:
    """The schema of a kind of document, by default that of balance sheets."""
    out = F.lit("balance_sheet")
    for name, schema in SCHEMAS.items():
        out = F.when(F.lower(kind) == name, schema).otherwise(out)
    return out


def checked_by_kind(rows: DataFrame, key: str, kind: str, checks: dict[str, dict[str, Column]]) -> DataFrame:
    """(key, check) of failed checks, each row against the schema of its kind."""
    schema = schema_of(F.col(kind))
    failed = F.array(*[F.when((schema == s) & ~F.coalesce(ok, F.lit(False)), F.lit(name)) for s, by in checks.items() for name, ok in by.items()])
    return rows.select(key, F.explode(F.array_compact(failed)).alias("check"))


def balance_columns(df: DataFrame) -> DataFrame:
    """Totals and balance of a balance-sheet record."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = df.withColumns({"total_assets": z("current_assets") + z("non_current_assets"), "total_liabilities": z("current_liabilities") + z("non_current_liabilities")})
    out = out.withColumn("total_liabilities_and_equity", F.col("total_liabilities") + z("equity"))
    out = out.withColumn("balance_difference", F.abs(F.col("total_assets") - F.col("total_liabilities_and_equity")))
    return out.withColumn("is_balanced", F.col("balance_difference") < 0.01)


def income_columns(df: DataFrame) -> DataFrame:
    """Gross profit, operating and net income of an income statement, and what was reported besides."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = df.withColumn("calculated_gross_profit", z("revenue") - z("cost_of_sales"))
    out = out.withColumn("calculated_operating_income", F.col("calculated_gross_profit") - z("operating_expenses"))
    out = out.withColumn("calculated_net_income", F.col("calculated_operating_income") + z("financial_result") - z("income_tax"))
    return out.withColumn("net_income_discrepancy", F.abs(F.col("reported_net_income") - F.col("calculated_net_income")))


def record_valid(qcs: Column, coercion: Column, review: Column, balanced: Column) -> Column:
    return (qcs >= 0.75) & (coercion < 0.05) & ~review & F.coalesce(balanced, F.lit(True))
