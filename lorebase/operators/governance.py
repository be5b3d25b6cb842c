"""Forgetting, import and export, inspection, audit, provenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.access import Principal, severity_rank, visible

#: What a request to forget names, by its scope.
SCOPES = {"entity": ("entity_id",), "session": ("session_id",), "time_range": ("before", "after"), "query": ("query",), "topic": ("topics",), "all": ()}


@dataclass(frozen=True)
class ForgetRequest:
    """A request to forget; before and after are moments as text."""

    scope: str
    entity_id: str | None = None
    session_id: str | int | None = None
    before: str | None = None
    after: str | None = None
    query: str | None = None
    topics: Sequence[str] = ()
    hard: bool = True

    def problems(self) -> list[str]:
        """What is missing for the scope; an unknown scope is a problem of its own."""
        if self.scope not in SCOPES:
            return [f"unknown scope {self.scope!r}"]
        needed = SCOPES[self.scope]
        return [f"{' or '.join(needed)} is required for {self.scope}"] if needed and not any(getattr(self, n) for n in needed) else []

    def chosen(self, at: str, entity: str = "id", session: str = "session_id", text: Column | None = None, tags: Column | None = None) -> Column:
        """The condition of the rows that are meant."""
        if self.scope == "entity":
            return F.col(entity) == self.entity_id
        if self.scope == "session":
            return F.col(session) == self.session_id
        if self.scope == "time_range":
            moment = lambda t: None if t is None else F.lit(t).cast("timestamp_ntz")
            return outside(moment(self.before), moment(self.after), at)
        if self.scope == "query":
            return F.contains(F.lower(text), F.lit((self.query or "").lower()))
        if self.scope == "topic":
            carried = F.transform(F.coalesce(F.col("tags") if tags is None else tags, F.array().cast("array<string>")), F.lower)
            return F.arrays_overlap(carried, F.array(*[F.lit(t.lower()) for t in self.topics]))
        return F.lit(True)


def own(df: DataFrame, who: Principal) -> DataFrame:
    """What a principal may delete: their own rows, or all of their tenant for an admin."""
    mine = F.col("owner_id") == who.user_id
    if "admin" in who.roles and who.tenant_id is not None:
        mine = mine | (F.col("tenant_id") == who.tenant_id)
    return df.filter(mine)


def forgotten(df: DataFrame, chosen: Column, who: Principal) -> DataFrame:
    """The rows that a request reaches: chosen and owned."""
    return own(df, who).filter(F.coalesce(chosen, F.lit(False)))


def forget(df: DataFrame, chosen: Column, who: Principal, key: str, hard: bool = True) -> DataFrame:
    """The table after a request: without the rows (hard), or with them marked deleted (soft)."""
    gone = forgotten(df, chosen, who).select(key).distinct()
    if hard:
        return df.join(gone, key, "left_anti")
    return df.join(gone.withColumn("_gone", F.lit(True)), key, "left").withColumn("deleted", F.coalesce("_gone", F.lit(False))).drop("_gone")


def outside(before: Column | None, after: Column | None, at: str) -> Column:
    """Created before the one or after the other moment (either is enough)."""
    out = F.lit(False)
    if before is not None:
        out = out | (F.col(at) < before)
    return out | (F.col(at) > after) if after is not None else out


def forget_status(done: Column, failed: Column) -> Column:
    return F.when(failed == 0, "completed").when(done > 0, "partially_completed").otherwise("failed")


def imported(current: DataFrame, incoming: DataFrame, key: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table after an import, counts by outcome): rows without a key fail, known keys are skipped or overwritten."""
    flagged = incoming.join(current.select(F.col(key), F.lit(True).alias("_known")), key, "left")
    outcome = F.when(F.col(key).isNull(), "failed").when(F.col("_known") & F.lit(not overwrite), "skipped").otherwise("imported")
    flagged = flagged.withColumn("outcome", outcome)
    fresh = flagged.filter("outcome = 'imported'").drop("_known", "outcome")
    kept = current.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True), flagged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def upserted(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key of an append log; tombstones (deleted) are gone."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    out = log.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return out.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in log.columns else out


def inspected(items: DataFrame, *by: str) -> DataFrame:
    """Counts by each of several columns and overall, in one pass over grouping sets."""
    g = items.groupingSets([[F.col(b)] for b in by] + [[]], *by).agg(F.count(F.lit(1)).alias("n"), F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"), F.grouping_id().alias("gid"))
    out = F.lit("all")
    for i, b in enumerate(by):
        out = F.when(F.col("gid") == (1 << len(by)) - 1 - (1 << (len(by) - 1 - i)), b).otherwise(out)
    value = F.coalesce(*[F.col(b).cast("string") for b in by], F.lit("all"))
    return g.select(out.alias("dimension"), value.alias("item"), "n", "first_us", "last_us")


def top_tags(items: DataFrame, tags: str, k: int = 20) -> DataFrame:
    return items.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag").limit(k)


def audit_filter(
    log: DataFrame,
    who: Principal,
    actions: list[str] | None = None,
    least: str = "debug",
    success: bool | None = None,
    k: int = 100,
    resource: str | None = None,
    since: Column | None = None,
    until: Column | None = None,
) -> DataFrame:
    """Newest entries of the own tenant (all for an admin) by action, least severity, success, resource and time."""
    out = log if "admin" in who.roles else log.filter(F.col("tenant_id") == who.tenant_id)
    out = out.filter(F.col("action").isin(actions)) if actions else out
    out = out.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(least)))
    out = out if success is None else out.filter(F.col("success") == success)
    out = out if resource is None else out.filter(F.col("resource") == resource)
    out = out if since is None else out.filter(F.col("ts") >= since)
    out = out if until is None else out.filter(F.col("ts") <= until)
    return out.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(k)


def audit_statistics(log: DataFrame, since: Column) -> DataFrame:
    """By action and severity, with subtotals, over recent entries: number, failures, distinct users."""
    g = log.filter(F.col("ts") >= since).groupingSets([[F.col("action")], [F.col("severity")], []], "action", "severity")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failures"), F.count_distinct("user_id").alias("users")).select(
        F.coalesce("action", F.lit("*")).alias("action"), F.coalesce("severity", F.lit("*")).alias("severity"), "n", "failures", "users")


def access_summary(log: DataFrame, entity: str, at: str) -> DataFrame:
    return log.groupBy(entity).agg(F.count(F.lit(1)).alias("accesses"), F.max(at).alias("last_us"))


def corrected(items: DataFrame, patches: DataFrame, key: str, fields: list[str], who: Principal) -> DataFrame:
    """Items with the fields that a patch gives (null: unchanged), where the principal may change them."""
    p = patches.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    may = F.coalesce((F.col("owner_id") == who.user_id) | F.lit("admin" in who.roles), F.lit(False))
    return items.join(p, key, "left").withColumns({f: F.when(may, F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def with_event(chain: Column, at: Column, event: str, by: Column) -> Column:
    """A chain of provenance with one event more."""
    return F.array_append(chain, F.struct(at.alias("at"), F.lit(event).alias("event"), by.alias("by")))


def provenance(items: DataFrame, events: DataFrame, key: str, most: int = 100) -> DataFrame:
    """The chain of events of each item in order, its first ``most``, and their number; items without one get a single created event."""
    order = Window.partitionBy(key).orderBy("at", "event", "by")
    ranked = events.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    first = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "event", "by"))).alias("chain"))
    chain = first.join(events.groupBy(key).agg(F.count(F.lit(1)).alias("events")), key)
    made = F.array(F.struct(F.col("created_us").alias("at"), F.lit("created").alias("event"), F.col("owner_id").alias("by")))
    return items.join(chain, key, "left").select(key, F.coalesce("chain", made).alias("chain"), F.coalesce("events", F.lit(1).cast("long")).alias("events"))


def related_items(edges: DataFrame, items: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, sources, derived): of each item, the first few that it came from and that came from it."""
    def near(mine: str, other: str, name: str) -> DataFrame:
        e = edges.select(F.col(mine).alias(key), F.col(other).alias("o")).distinct().join(items.select(key), key, "left_semi")
        e = e.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("o"))).filter(F.col("n") <= most)
        return e.groupBy(key).agg(F.array_sort(F.collect_list("o")).alias(name))

    none = F.array().cast("array<string>")
    out = items.select(key).join(near("dst", "src", "sources"), key, "left").join(near("src", "dst", "derived"), key, "left")
    return out.select(key, F.coalesce("sources", none).alias("sources"), F.coalesce("derived", none).alias("derived"))


def entity_type(key: Column, node_type: Column) -> Column:
    """What kind of memory a row is: as it says, or by its id."""
    by_id = F.lit("unknown")
    for kind in ("working", "procedure", "experience", "belief"):
        by_id = F.when(F.contains(key, F.lit(f"/{kind}-")) | F.startswith(key, F.lit(f"{kind}-")), kind).otherwise(by_id)
    return F.coalesce(F.nullif(node_type, F.lit("")), by_id)


def shown(items: DataFrame, who: Principal) -> DataFrame:
    """Items with what the principal may see of them: those that are hidden keep their id and say so."""
    may = visible(who, F.col("owner_id"), F.col("tenant_id"), F.col("privacy_level"), F.col("shared_with"))
    return items.withColumn("access", F.when(may, "granted").otherwise("denied"))


def kept_by_retention(log: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """A log without entries older than a number of days."""
    return log.filter(F.col(at) >= now - F.expr(f"INTERVAL '{days}' DAY"))


def access_log(log: DataFrame, who: Principal, k: int = 100) -> DataFrame:
    """Newest entries: one's own, or all for an admin."""
    mine = log if "admin" in who.roles else log.filter(F.col("user_id") == who.user_id)
    return mine.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(k)


def revised(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """Decisions after revisions (decision_id, new_id, title): the old ones are superseded, the new ones name them."""
    old = decisions.join(changes.select("decision_id", F.lit("superseded").alias("_s")), "decision_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    new = changes.select(F.col("new_id").alias("decision_id"), "title", F.lit("active").alias("status"), F.col("decision_id").alias("revision_of"))
    return old.unionByName(new, allowMissingColumns=True)
