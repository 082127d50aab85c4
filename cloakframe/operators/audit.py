"""Audit log: append, query, count and summarise."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = datetime.datetime | str


@dataclass(frozen=True)
class AuditFilter:
    """Equality filters and a time range, since inclusive, until exclusive."""

    actor: str | None = None
    action: str | None = None
    target: str | None = None
    since: Moment | None = None
    until: Moment | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        for name in ("actor", "action", "target"):
            wanted = getattr(self, name)
            if wanted:
                log = log.where(F.col(name) == wanted)
        if self.since:
            log = log.where(F.col("created_at") >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until:
            log = log.where(F.col("created_at") < F.lit(self.until).cast("timestamp_ntz"))
        return log


def _or_null(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(""))


def audit_entries(entries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Entries as they are stored: unnamed actors and actions are ``unknown``, empty fields null."""
    return entries.select(
        *(keep or []),
        F.coalesce(_or_null(F.col("actor")), F.lit("unknown")).alias("actor"),
        F.coalesce(_or_null(F.col("action")), F.lit("unknown")).alias("action"),
        _or_null(F.col("target")).alias("target"),
        F.when(F.col("meta").isNotNull(), F.to_json("meta")).alias("meta"),
        _or_null(F.col("ip")).alias("ip"),
        _or_null(F.col("user_agent")).alias("user_agent"),
    )


def append_audit(entries: DataFrame, path: str) -> None:
    audit_entries(entries).write.mode("append").parquet(path)


def query_audit(log: DataFrame, where: AuditFilter = AuditFilter(), limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of the log, newest first; the page size defaults to 200 and stays within 1..1000."""
    size = max(limit or 200, 1)
    newest = where.apply(log).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return newest.offset(max(offset, 0)).limit(size)


def count_audit(log: DataFrame, where: AuditFilter = AuditFilter()) -> DataFrame:
    return where.apply(log).agg(F.count("*").alias("n"))


def summarise_audit(log: DataFrame, where: AuditFilter = AuditFilter()) -> DataFrame:
    counts = where.apply(log).groupBy("action").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "action")


def parsed_or_raw(meta: Column) -> Column:
    """JSON in canonical text when it parses, the raw text when it does not, null when empty."""
    parsed = F.try_parse_json(meta)
    return F.when(meta.isNull() | (meta == ""), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.to_json(parsed), meta)
    )


def actor_label(label: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("dashboard:"), label)).otherwise("dashboard")


def client_ip(forwarded: Column, direct: Column) -> Column:
    """First address of a forwarding list, else the direct address."""
    first = F.split(forwarded, ",", -1)[0]
    return F.trim(F.coalesce(F.nullif(first, F.lit("")), direct, F.lit("")))
