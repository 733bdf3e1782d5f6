"""Queries of the operational store: pages, queues, key performance figures, state machine, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import latest

# Transitions that the review allows.
TRANSITIONS = {("draft", "validated"), ("draft", "rejected"), ("validated", "archived")}


def page(rows: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of at most 200 rows; order should end with a unique key."""
    return rows.orderBy(*order).offset(offset).limit(max(1, min(limit, 200)))


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def latest_job(jobs: DataFrame, key: str = "document_id", order: str = "created_at", done: bool = False) -> DataFrame:
    rows = jobs.filter(F.col("status") == "done") if done else jobs
    return latest(rows, [key], F.col(order).desc(), F.col("job_id").desc())


def review_queue(documents: DataFrame, jobs: DataFrame, org) -> DataFrame:
    """A tenant's documents with their latest job, newest first."""
    last = latest_job(jobs).select("document_id", "job_id", "status", "qcs")
    return documents.filter(F.col("org_id") == org).join(last, "document_id", "left").orderBy(F.col("created_at").desc(), "document_id")


def quality_kpis(jobs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Automation, review and correction rates over done jobs, 0 where nothing was done."""
    done = jobs.filter(F.col("status") == "done")
    base = done.agg(F.count("*").alias("jobs"), F.count_if(~F.col("needs_review")).alias("automated"), F.avg("qcs").alias("avg_qcs"))
    fixed = corrections.agg(F.countDistinct("document_id").alias("corrected"))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("jobs")), F.lit(0.0))
    return base.join(fixed).select("jobs", rate("automated").alias("automation_rate"), (1 - rate("automated")).alias("review_rate"), F.coalesce("avg_qcs", F.lit(0.0)).alias("avg_qcs"), rate("corrected").alias("correction_rate"))


def rule_flags(reports: DataFrame) -> DataFrame:
    """Mean pass rate of reports with checks, and share of jobs with a critical failure."""
    return reports.agg(
        F.coalesce(F.avg(F.when(F.col("total") > 0, F.col("passed") / F.col("total"))), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(F.avg((F.col("critical") > 0).cast("int")), F.lit(0.0)).alias("critical_rate"),
    )


def promotable(log: DataFrame, least: int = 3) -> DataFrame:
    """Variations seen at least so often that always meant the same term."""
    seen = log.groupBy("raw_text", "matched_to").agg(F.count("*").alias("n"))
    alone = F.count("*").over(W.partitionBy("raw_text"))
    return seen.withColumn("terms", alone).filter((F.col("n") >= least) & (F.col("terms") == 1)).select("raw_text", "matched_to", "n")


def approved(log: DataFrame) -> DataFrame:
    """The last approved meaning of each raw text."""
    return log.filter("approved").groupBy("raw_text").agg(F.max_by("matched_to", "ts").alias("matched_to"))


def log_candidates(matches: DataFrame, sure: float = 0.95) -> DataFrame:
    """Uncertain matches that go to the variation log."""
    return matches.filter(F.col("match_type").isin("fuzzy", "resolved") & (F.col("match_confidence") < sure)).select(F.col("label").alias("raw_text"), F.col("canonical").alias("matched_to"), "match_type", "match_confidence")


def transition(documents: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (document_id, target, version) against documents (document_id, status, version): new status and code.

    200 moved, 409 illegal move, 412 another version, 404 unknown document.
    """
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(TRANSITIONS)])
    joined = commands.join(documents.select("document_id", "status", F.col("version").alias("held")), "document_id", "left")
    legal = F.array_contains(allowed, F.concat_ws(">", "status", "target"))
    code = F.when(F.col("status").isNull(), 404).when(F.col("version").isNotNull() & (F.col("version") != F.col("held")), 412).when(~legal, 409).otherwise(200)
    return joined.withColumn("code", code).withColumn("new_status", F.when(F.col("code") == 200, F.col("target")).otherwise(F.col("status")))


def corrections_to_variations(corrections: DataFrame) -> DataFrame:
    """Corrections that name raw text and term seed approved variations."""
    return corrections.filter(F.col("raw_text").isNotNull() & F.col("canonical").isNotNull()).select("raw_text", F.col("canonical").alias("matched_to"), F.lit(True).alias("approved"), "ts")


def deliveries(sent: DataFrame, endpoints: DataFrame, org) -> DataFrame:
    return sent.join(endpoints.filter(F.col("org_id") == org), "endpoint_id").orderBy(F.col("created_at").desc(), "delivery_id")


def rate_limited(requests: DataFrame, limit: int = 30, window: str = "60 seconds") -> DataFrame:
    """Windows in which a principal sent more requests than allowed."""
    return requests.groupBy("principal", F.window("ts", window)).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("principal", F.col("window.start").alias("start"), "n")


def upsert(current: DataFrame, changes: DataFrame, keys) -> DataFrame:
    """Rows of current replaced or joined by those of changes."""
    return current.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def retry_backoff(attempt: Column, cap: int = 600) -> Column:
    return F.least(F.lit(float(cap)), F.pow(F.lit(2.0), attempt.cast("double")))


def ground_truth(corrections: DataFrame, org) -> DataFrame:
    return corrections.filter(F.col("org_id") == org).orderBy("created_at", "correction_id")


def owned(rows: DataFrame, key: str, value, org) -> DataFrame:
    """A tenant's row by id; empty if it is another's."""
    return rows.filter((F.col(key) == value) & (F.col("org_id") == org))


def audit_trail(events: DataFrame, document) -> DataFrame:
    return events.filter(F.col("document_id") == document).orderBy("ts", "event_id")


def assign(documents: DataFrame, assignments: DataFrame, me: str) -> DataFrame:
    """Documents with the reviewer of their assignment, oneself where none is named."""
    named = assignments.select("document_id", F.coalesce("reviewer", F.lit(me)).alias("assigned"))
    return documents.join(named, "document_id", "left").withColumn("reviewer", F.coalesce("assigned", "reviewer")).drop("assigned")


def decide_variations(variations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Variations approved or rejected by their id."""
    return variations.join(decisions.select("variation_id", "approve"), "variation_id", "left").withColumn("status", F.when(F.col("approve"), "approved").when(~F.col("approve"), "rejected").otherwise(F.col("status"))).drop("approve")


def confirmed_customs(log: DataFrame) -> DataFrame:
    return log.filter(F.col("match_type") == "confirmed_custom").select(F.col("raw_text").alias("label")).distinct()


def job_step(jobs: DataFrame, outcomes: DataFrame, retries: int = 3) -> DataFrame:
    """Jobs after their run (job_id, ok, error): done, queued again with a wait, or failed; errors keep 4000 characters.

    Errors are cut before they are joined. They are merged, never broadcast: Spark takes any text for 20 bytes when it plans.
    """
    ends = outcomes.withColumn("error", F.substring("error", 1, 4000))
    out = jobs.join(ends.hint("merge"), "job_id", "left")
    again = (F.col("ok") == F.lit(False)) & (F.col("attempt") < retries)
    return out.withColumns({
        "status": F.when(F.col("ok"), "done").when(again, "queued").when(F.col("ok") == F.lit(False), "failed").otherwise(F.col("status")),
        "wait": F.when(again, retry_backoff(F.col("attempt"))),
        "attempt": F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")),
    }).drop("ok")


def replay(sent: DataFrame, wanted: DataFrame) -> DataFrame:
    """Deliveries set back to pending."""
    hit = wanted.select("delivery_id", F.lit(True).alias("again"))
    return sent.join(hit, "delivery_id", "left").withColumns({"status": F.when(F.col("again"), "pending").otherwise(F.col("status")), "attempts": F.when(F.col("again"), 0).otherwise(F.col("attempts"))}).drop("again")


def several_statements(segments: DataFrame, keys) -> DataFrame:
    """Documents with more than one known kind of statement: cross checks apply."""
    return segments.filter("statement <> 'unknown'").groupBy(*keys).agg((F.countDistinct("statement") > 1).alias("cross"))
