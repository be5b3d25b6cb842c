"""The facade's operations by name, for tools and agents: one dispatch a group of actions.

Each action is a function of the store and of keyword arguments; it returns a DataFrame or a
small value.  An unknown action is an error that names the known ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import functions as F

from lorebase.functions import access
from lorebase.memory import Memory
from lorebase.operators import beliefs as B
from lorebase.operators import governance as G

Action = Callable[..., Any]


@dataclass(frozen=True)
class Tool:
    """Named actions on one store."""

    memory: Memory
    actions: dict[str, Action]

    def invoke(self, action: str, **how: Any) -> Any:
        if action not in self.actions:
            raise ValueError(f"unknown action {action!r}; there are {', '.join(sorted(self.actions))}")
        return self.actions[action](self.memory, **how)


def memory_tool(memory: Memory) -> Tool:
    """Remember and recall."""
    return Tool(memory, {
        "commit_belief": Memory.commit, "record_experience": Memory.record, "learn_procedure": Memory.learn, "record_decision": Memory.decide, "store_snapshot": Memory.snapshot, "add_edge": Memory.connect,
        "recall": Memory.recall, "recall_all": Memory.recall_all, "context": Memory.context, "get": Memory.get, "neighbours": Memory.neighbours, "snapshots": Memory.snapshots,
    })


def query_tool(memory: Memory) -> Tool:
    """Ask what is known."""
    return Tool(memory, {
        "what_do_you_know": Memory.what_do_you_know, "contradictions": Memory.contradictions, "entity": lambda m, name: B.by_entity(m.beliefs(), name),
        "verify": lambda m, subject, object_: verified(m, subject, object_), "graph": lambda m, start, **how: m.graph().start(start).traverse(**how).execute(),
    })


def verified(memory: Memory, subject: str, object_: str):
    """One row: what is known of a claim about a subject."""
    about = memory.beliefs().filter(F.lower("subject") == subject.lower())
    claim = about.agg(
        (F.count_distinct(F.lower("object")) > 1).cast("int").alias("contradictions"), F.max(F.when(F.lower("object") == object_.lower(), F.coalesce("confidence", F.lit(1.0)))).alias("best"),
    )
    return claim.select(B.verdict(claim).alias("verdict"), "best")


def privacy_tool(memory: Memory) -> Tool:
    """Privacy, forgetting, export and the audit log."""
    return Tool(memory, {
        "set_privacy": Memory.set_privacy, "share": Memory.share, "forget": lambda m, updated_us, **request: m.forget_request(G.ForgetRequest(**request), updated_us), "audit": Memory.audit, "log": Memory.log,
        "export": lambda m: G.own(m.beliefs(), m.who), "import": lambda m, rows, updated_us, overwrite=False: imported(m, rows, updated_us, overwrite),
        "inspect": lambda m: G.inspected(m.beliefs().withColumn("created_us", F.col("updated_us")), "privacy_level", "status"), "access_log": lambda m, k=100: G.access_log(m.all("audit"), m.who, k),
        "may_remember": lambda m, text, tags=(): m.spark.range(1).select(access.may_remember(m.preferences, F.lit(text), F.array(*[F.lit(t) for t in tags]).cast("array<string>")).alias("ok")).first()["ok"],
    })


def imported(memory: Memory, rows, updated_us: int, overwrite: bool = False) -> dict[str, int]:
    """Beliefs under the principal's name; how many were imported, skipped and refused."""
    known = memory.beliefs().select("belief_id")
    _, counts = G.imported(known, rows.select("belief_id"), "belief_id", overwrite)
    fresh = rows.filter("belief_id is not null")
    fresh = fresh if overwrite else fresh.join(known, "belief_id", "left_anti")
    out = {r.outcome: r.n for r in counts.collect()}  # three rows at most
    memory.commit(fresh, updated_us)
    return out
