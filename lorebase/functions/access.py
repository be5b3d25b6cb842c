"""Who may see what: row-level access, attribute policies, preferences, consent, retention."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PII = {"ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "card": r"[0-9]{16}", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}


@dataclass(frozen=True)
class Principal:
    """Who asks."""

    user_id: str
    tenant_id: str | None = None
    roles: tuple[str, ...] = ("member",)


def visible(who: Principal, owner: Column, tenant: Column, privacy: Column, shared_with: Column) -> Column:
    """Row-level access, in order: own; of another tenant only what is public; admin; public; workspace for members; shared.

    A null tenant passes the tenant test.
    """
    other = tenant != who.tenant_id if who.tenant_id is not None else F.lit(False)
    insider = bool({"member", "viewer", "admin"} & set(who.roles))
    return (
        F.when(owner == who.user_id, True)
        .when(F.coalesce(other, F.lit(False)), privacy == "public")
        .when(F.lit("admin" in who.roles), True)
        .when(privacy == "public", True)
        .when((privacy == "workspace") & F.lit(insider), True)
        .otherwise(F.coalesce(F.array_contains(shared_with, who.user_id), F.lit(False)))
    )


@dataclass(frozen=True)
class Policy:
    """If the condition holds, the effect is final for all policies of lower priority."""

    name: str
    priority: int
    condition: Column
    allow: bool


def default_policies(who: Principal, permission: str, owner: Column, tenant: Column, privacy: Column, shared_with: Column) -> list[Policy]:
    same = tenant == F.lit(who.tenant_id)
    reading = F.lit(permission == "read")
    return [
        Policy("owner", 100, owner == who.user_id, True),
        Policy("other_tenant", 95, ~same & (privacy != "public"), False),
        Policy("admin", 90, same & F.lit("admin" in who.roles), True),
        Policy("public_read", 80, reading & (privacy == "public"), True),
        Policy("workspace_read", 70, reading & same & (privacy == "workspace") & F.lit(bool({"member", "admin"} & set(who.roles))), True),
        Policy("viewer_read", 60, reading & same & (privacy == "workspace") & F.lit("viewer" in who.roles), True),
        Policy("shared_read", 50, reading & F.array_contains(shared_with, who.user_id), True),
    ]


def decided(policies: Sequence[Policy]) -> Column:
    """(allowed, policy): the first match by priority wins, none denies; equal priorities keep their order."""
    out = None
    for p in sorted(policies, key=lambda p: -p.priority):
        hit = F.struct(F.lit(p.allow).alias("allowed"), F.lit(p.name).alias("policy"))
        out = F.when(p.condition, hit) if out is None else out.when(p.condition, hit)
    none = F.struct(F.lit(False).alias("allowed"), F.lit("default").alias("policy"))
    return none if out is None else out.otherwise(none)


#: Columns of a table of policies; ``since`` orders the changes of one name, ``removed`` ends it.
POLICIES = "name string, priority int, condition string, allow boolean, since bigint, removed boolean"
#: What people write comes to the driver; a larger table is an error, not cut.
MOST_POLICIES = 1000


def policies_of(table: DataFrame, columns: Sequence[str]) -> list[Policy]:
    """Policies from rows (:data:`POLICIES`): of each name the latest change, unless it removes the name.

    A condition is SQL over ``columns`` and nothing else: one that can't be read, isn't boolean or names another column is an error
    that names the policy.  A condition that is null for a row doesn't match it.
    """
    latest = table.groupBy("name").agg(F.max_by(F.struct(*[c for c in table.columns if c != "name"]), F.struct("since", "removed", "priority", "condition", "allow")).alias("p"))
    rows = latest.filter(~F.coalesce("p.removed", F.lit(False))).select("name", "p.*").orderBy(F.desc("priority"), "name").limit(MOST_POLICIES + 1).collect()
    if len(rows) > MOST_POLICIES:
        raise ValueError(f"more than {MOST_POLICIES} policies")
    out = []
    for r in rows:
        try:
            kind = table.sparkSession.createDataFrame([], ", ".join(columns)).select(F.expr(r["condition"]).alias("c")).schema["c"].dataType.simpleString()
        except Exception as e:
            raise ValueError(f"policy {r['name']}: {str(e).splitlines()[0]}") from e
        if kind != "boolean":
            raise ValueError(f"policy {r['name']}: its condition is {kind}")
        out.append(Policy(r["name"], r["priority"], F.coalesce(F.expr(r["condition"]), F.lit(False)), bool(r["allow"])))
    return out


@dataclass
class Preferences:
    """What a user wants remembered, and for how long."""

    store: bool = True
    blocked_topics: list[str] = field(default_factory=list)
    blocked_patterns: list[str] = field(default_factory=list)
    default_days: int = 365
    max_days: int | None = None

    @classmethod
    def private(cls) -> Preferences:
        """The cautious preset: personal data blocked, short retention."""
        return cls(blocked_patterns=list(PII.values()), default_days=30, max_days=90)

    def blocking(self, *topics: str, patterns: Sequence[str] = ()) -> Preferences:
        """These preferences with more that is blocked; what is blocked already stays once."""
        merged = lambda old, new: list(dict.fromkeys([*old, *new]))
        return replace(self, blocked_topics=merged(self.blocked_topics, topics), blocked_patterns=merged(self.blocked_patterns, patterns))

    def allowing(self, *topics: str) -> Preferences:
        """These preferences without some blocked topics, in any case of letters."""
        low = {t.lower() for t in topics}
        return replace(self, blocked_topics=[t for t in self.blocked_topics if t.lower() not in low])


def may_remember(p: Preferences, content: Column, tags: Column) -> Column:
    ok = F.lit(p.store)
    for topic in p.blocked_topics:
        ok = ok & ~F.contains(F.lower(content), F.lit(topic.lower())) & ~F.array_contains(F.transform(tags, F.lower), topic.lower())
    for pattern in p.blocked_patterns:
        ok = ok & ~content.rlike(f"(?i){pattern}")
    return ok


def retention_days(p: Preferences, requested: Column) -> Column:
    days = F.coalesce(requested, F.lit(p.default_days))
    return days if p.max_days is None else F.least(days, F.lit(p.max_days))


def grant(consents: Column, purpose: str, when: Column) -> Column:
    """A map of consents with one more; the later grant counts."""
    return F.map_concat(F.map_filter(consents, lambda k, _: k != purpose), F.create_map(F.lit(purpose), when))


def revoke(consents: Column, purpose: str) -> Column:
    return F.map_filter(consents, lambda k, _: k != purpose)


def share(shared_with: Column, user: str) -> Column:
    return F.array_union(shared_with, F.array(F.lit(user)))


def unshare(shared_with: Column, user: str) -> Column:
    return F.array_remove(shared_with, user)


# Actions whose entries are warnings, and those that are only of interest when looking for faults.
WARNED = ("forget_all", "policy_change", "config_change", "delete", "forget", "forget_session", "export", "access_denied")
QUIET = ("read", "query", "search")


def default_severity(action: Column, success: Column | None = None) -> Column:
    """What an audit entry weighs by its action; a failure is a warning."""
    out = F.when(action.isin(*WARNED), "warning").when(action.isin(*QUIET), "debug").otherwise("info")
    return out if success is None else F.when(~success, "warning").otherwise(out)


def retention_over(retention_until: Column, as_of: str) -> Column:
    """Whether a row's retention has ended; without an end it never does."""
    return F.coalesce(F.lit(as_of).cast("timestamp_ntz") > retention_until, F.lit(False))


def may_change(who: Principal, owner: Column) -> Column:
    """Privacy is changed by the owner or an admin."""
    return F.coalesce((owner == who.user_id) | F.lit("admin" in who.roles), F.lit(False))


def without(policies: Sequence[Policy], name: str) -> list[Policy]:
    """Policies but the named one; replace a policy by adding one of its name to the rest."""
    return [p for p in policies if p.name != name]


#: Audit severities in order.
SEVERITY = {"debug": 0, "info": 1, "warning": 2, "error": 3, "critical": 4}


def severity_rank(severity: Column) -> Column:
    out = F.lit(-1)
    for name, rank in SEVERITY.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out
