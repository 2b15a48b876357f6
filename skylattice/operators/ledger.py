"""Decisions over a ledger of fetch attempts: classes, waits, ends, resume points and completeness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RetryRules:
    """Limits of a fetch: attempts, first delay and its growth (another after timeouts), caps, token refreshes, and whether
    a token can be refreshed at all."""

    attempts: int = 5
    first_delay: float = 2.0
    growth: float = 1.5
    most_delay: float | None = 60.0
    most_retry_after: int | None = 300
    refreshes: int | None = 3
    refreshing: bool = True
    timeout_growth: float = 2.0
    most_after_timeout: float | None = 120.0
    smallest_resume: int = 1 << 20


DOWNLOAD = RetryRules()
#: Metadata lookups: no caps, no token refresh, every failure is an attempt.
LOOKUP = RetryRules(most_delay=None, most_retry_after=None, refreshes=None)
#: Status of an attempt that timed out before there was an answer.
TIMED_OUT = -1


def response_class(status: Column, rules: RetryRules = DOWNLOAD) -> Column:
    """``ok``, ``unauthorized``, ``rate_limited``, ``server_error``, ``timeout`` or ``failed`` (another exception or client
    error)."""
    ok = status.isin(200, 206, 416) if rules.refreshes is not None else status.isin(200, 206)
    out = F.when(ok, "ok")
    if rules.refreshes is not None:
        out = out.when(status == 401, "unauthorized")
    out = out.when(status == TIMED_OUT, "timeout")
    return out.when(status == 429, "rate_limited").when((status >= 500) & (status < 600), "server_error").otherwise("failed")


def retry_plan(attempts: DataFrame, rules: RetryRules = DOWNLOAD, *, file: str = "file_id", seq: str = "seq") -> DataFrame:
    """The attempts that would be made, each with its class, ``wait`` before the next and ``verdict``: ``ok``, ``retry``,
    ``refresh_limit``, ``unauthorized`` (no way to refresh) or ``exhausted``. Rows after a file's first end are left out; no
    driver loop, one window a file. The delay grows with each failure and each timeout before, in their order: a row before
    the end has fewer than ``attempts`` and ``refreshes`` together before it."""
    before = Window.partitionBy(file).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.count_if(c).over(before), F.lit(0))
    kind = F.col("class")
    rows = attempts.withColumn("class", response_class(F.col("status"), rules))
    spent = ~kind.isin("ok", "unauthorized")
    rows = rows.withColumns({"refreshes_before": count(kind == "unauthorized"), "spent_before": count(spent), "kinds_before": F.collect_list(kind).over(Window.partitionBy(file).orderBy(seq).rowsBetween(-(rules.attempts + (rules.refreshes or 0)), -1))})
    over = (kind == "unauthorized") & (F.col("refreshes_before") >= rules.refreshes) if rules.refreshes is not None else F.lit(False)
    verdict = F.when(kind == "ok", "ok").when((kind == "unauthorized") & F.lit(not rules.refreshing), "unauthorized").when(over, "refresh_limit").when(spent & (F.col("spent_before") + 1 >= rules.attempts), "exhausted").otherwise("retry")
    capped = lambda v, most: F.least(v, F.lit(most)) if most else v
    delay = F.aggregate("kinds_before", F.lit(rules.first_delay), lambda d, k: F.when(k == "failed", capped(d * rules.growth, rules.most_delay)).when(k == "timeout", capped(d * rules.timeout_growth, rules.most_after_timeout)).otherwise(d))
    asked = F.col("retry_after").cast("double")
    # least() skips nulls, so an absent header must be kept apart from the cap.
    asked = F.when(asked.isNotNull(), F.least(asked, F.lit(float(rules.most_retry_after)))) if rules.most_retry_after else asked
    wait = F.when(kind == "rate_limited", F.coalesce(asked, delay)).when(spent, delay).otherwise(F.lit(0.0))
    rows = rows.withColumn("verdict", verdict).withColumn("wait", wait)
    ended = F.coalesce(F.count_if(F.col("verdict") != "retry").over(before), F.lit(0))
    return rows.withColumn("ended", ended).where("ended = 0").drop("ended", "refreshes_before", "spent_before", "kinds_before")


def outcomes(plan: DataFrame, *, file: str = "file_id", seq: str = "seq") -> DataFrame:
    """One row a file: its last verdict (``pending`` if more attempts are due), attempts made and bytes of the last one."""
    last = F.max_by(F.struct("verdict", "bytes"), seq)
    return plan.groupBy(file).agg(last.alias("last"), F.count("*").alias("made")).select(file, F.when(F.col("last.verdict") == "retry", "pending").otherwise(F.col("last.verdict")).alias("outcome"), "made", "last.bytes")


def resume_position(size: Column, enabled: bool = True, rules: RetryRules = DOWNLOAD) -> Column:
    """Bytes of a part file worth keeping: none if it is absent, too small or resuming is off."""
    return F.when(F.lit(enabled) & (size >= rules.smallest_resume), size).otherwise(F.lit(0).cast("long"))


def complete(size: Column, content_length: Column, position: Column, status: Column) -> Column:
    """Whether a file is whole: the length counts from the resume point; unknown lengths and 416 pass."""
    start = F.when(status == 200, F.lit(0)).otherwise(position)
    return (status == 416) | F.coalesce(content_length, F.lit(0)).eqNullSafe(0) | (size == content_length + start)
