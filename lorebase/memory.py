"""A thin facade: a knowledge store in a folder, for one principal.

Each kind of memory is an append log of its own under the folder (:data:`lorebase.sources.files.TABLES`);
the latest row of a key counts, a tombstone ends it.  Every read is limited to what the
principal may see, and takes its moment as an argument.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import access, scoring, temporal
from lorebase.operators import beliefs as B
from lorebase.operators import governance as G
from lorebase.operators import retrieval as R
from lorebase.operators import text as T
from lorebase.operators.graph import GraphQuery, both_ways
from lorebase.sources import files
from lorebase.storage import materialise


def described(b: DataFrame) -> Column:
    """What a belief says: its content, or its statement."""
    return F.coalesce(F.nullif("content", F.lit("")), F.concat_ws(" ", "subject", "predicate", "object"))


@dataclass
class Memory:
    """A store under ``path``, as ``who`` sees it."""

    spark: SparkSession
    path: str
    who: access.Principal
    preferences: access.Preferences = field(default_factory=access.Preferences)

    # -- tables ---------------------------------------------------------------------------------

    def append(self, table: str, rows: DataFrame, updated_us: int) -> None:
        """Append rows of the principal to a table, in its columns and types."""
        own = rows.withColumns({"owner_id": F.lit(self.who.user_id), "tenant_id": F.lit(self.who.tenant_id), "updated_us": F.lit(updated_us)})
        schema = files.TABLES[table][0]
        columns = self.spark.createDataFrame([], schema).columns
        own = own.withColumn("deleted", F.coalesce("deleted", F.lit(False)) if "deleted" in own.columns else F.lit(False))
        files.append(own.select(*[c for c in own.columns if c in columns]), f"{self.path}/{table}", schema=schema)

    def all(self, table: str) -> DataFrame:
        """The latest rows of a table that the principal may see; an absent table is empty."""
        schema, key = files.TABLES[table]
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        rows = files.latest(self.spark, f"{self.path}/{table}", key, "updated_us", schema=schema) if key else self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        if "privacy_level" not in rows.columns:
            return rows
        return rows.filter(access.visible(self.who, rows.owner_id, rows.tenant_id, F.coalesce(rows.privacy_level, F.lit("private")), rows.shared_with))

    def get(self, table: str, *ids: str) -> DataFrame:
        """Rows by id, as far as the principal may see them."""
        return self.all(table).filter(F.col(files.TABLES[table][1]).isin(list(ids)))

    # -- what is remembered ---------------------------------------------------------------------

    def commit(self, beliefs: DataFrame, updated_us: int) -> None:
        """Append beliefs of the principal; those that the preferences forbid stay out."""
        tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in beliefs.columns else F.array().cast("array<string>")
        content = described(beliefs) if "content" in beliefs.columns else F.concat_ws(" ", "subject", "predicate", "object")
        self.append("beliefs", beliefs.filter(access.may_remember(self.preferences, content, tags)), updated_us)

    def record(self, experiences: DataFrame, updated_us: int) -> None:
        """Append experiences; one that names its cause gets an edge from it."""
        self.append("experiences", experiences, updated_us)
        if "causal_parent" in experiences.columns:
            caused = experiences.filter("causal_parent is not null")
            self.connect(caused.select(F.col("causal_parent").alias("src"), F.col("experience_id").alias("dst"), F.lit("caused").alias("edge_type")), updated_us)

    def learn(self, procedures: DataFrame, updated_us: int) -> None:
        self.append("procedures", procedures, updated_us)

    def decide(self, decisions: DataFrame, updated_us: int) -> None:
        """Append decisions, with an edge to each belief that they assume."""
        self.append("decisions", decisions, updated_us)
        if "assumptions" in decisions.columns:
            self.connect(R.assumed(decisions), updated_us)

    def snapshot(self, snapshots: DataFrame, updated_us: int) -> None:
        self.append("snapshots", snapshots, updated_us)

    def connect(self, edges: DataFrame, updated_us: int) -> None:
        """Append edges; description and embedding make them findable by meaning."""
        self.append("edges", edges, updated_us)

    def save_rules(self, rules: Sequence[T.Detector | T.Extractor], updated_us: int) -> int:
        """Save usable rules under their ids; returns how many are usable."""
        good = T.usable_rules(list(rules))
        rows = [
            (r.id, "detector" if isinstance(r, T.Detector) else "extractor", getattr(r, "entity_type", None), r.pattern, getattr(r, "template", None), getattr(r, "confidence", None), getattr(r, "description", ""), False, updated_us)
            for r in good
        ]
        if rows:
            files.append(self.spark.createDataFrame(rows, files.RULES), f"{self.path}/rules", schema=files.RULES)
        return len(good)

    def rules(self) -> list[T.Detector | T.Extractor]:
        """All saved rules, by id; there are as many as people write, so they come to the driver."""
        rows = self.all("rules").orderBy("rule_id").collect()
        return [T.Detector(r.rule_id, r.pattern, r.description or "") if r.kind == "detector" else T.Extractor(r.rule_id, r.entity_type, r.pattern, r.template, r.confidence, r.description or "") for r in rows]

    def delete_rule(self, rule_id: str, updated_us: int) -> None:
        gone = self.all("rules").filter(F.col("rule_id") == rule_id).withColumns({"deleted": F.lit(True), "updated_us": F.lit(updated_us)})
        files.append(gone, f"{self.path}/rules", schema=files.RULES)

    def similar_rules(self, description: str, k: int = 5) -> DataFrame:
        """Rules whose description and expression match a text best."""
        text = self.all("rules").withColumn("_t", F.concat_ws(" ", "description", "pattern", "entity_type"))
        return scoring.top(scoring.bm25(text, scoring.query_terms(description), "rule_id", "_t"), "score", "rule_id", k)

    # -- what is read ---------------------------------------------------------------------------

    def beliefs(self) -> DataFrame:
        return self.all("beliefs")

    def neighbours(self, node: str, k: int = 20) -> DataFrame:
        """Nodes next to a node in either direction, with their edges' types."""
        near = both_ways(self.all("edges").select("src", "dst", "edge_type")).filter(F.col("src") == node)
        return near.select(F.col("dst").alias("node"), "edge_type").distinct().orderBy("node", "edge_type").limit(k)

    def snapshots(self, task_context: str, k: int = 10) -> DataFrame:
        """Snapshots of a task, newest first."""
        return R.newest(self.all("snapshots").filter(F.col("task_context") == task_context), "taken_at", "snapshot_id", k)

    def recall(self, as_of: str, terms: list[str] | None = None, profile: str = "decision_support", k: int = 20, least: float = 0.3, seeds: DataFrame | None = None) -> DataFrame:
        """Valid, uncontested beliefs by text, recency, confidence and nearness in the graph under a profile; an unknown profile is an error."""
        p = scoring.PROFILES[profile]
        b = self.beliefs().filter(~F.coalesce("status", F.lit("validated")).isin("rejected", "contested") & (F.coalesce("confidence", F.lit(1.0)) >= least))
        b = b.filter(temporal.valid_at(F.col("valid_from"), F.col("valid_until"), as_of))
        signals: dict[str, Column] = {"confidence": F.coalesce("confidence", F.lit(1.0)), "temporal": scoring.temporal(temporal.age_seconds(F.col("observed_at"), as_of) / 3600, p.half_life_days * 24)}
        if terms:
            text = scoring.bm25(b.withColumn("_t", described(b)), [t.lower() for t in terms], "belief_id", "_t").withColumnRenamed("score", "_text")
            b = b.join(text, "belief_id", "left")
            signals["text"] = F.col("_text") / (F.col("_text") + 1)
        if seeds is not None:
            edges = self.beliefs().select(F.col("subject").alias("src"), F.col("object").alias("dst"))
            b = b.join(R.nearness(edges, seeds).withColumnsRenamed({"node": "subject", "near": "_near"}), "subject", "left")
            signals["graph"] = F.col("_near")
        score = scoring.reranked(scoring.weighted(signals, p.weights()), scoring.entropy(F.coalesce("confidence", F.lit(1.0))), p.entropy, p.direction)
        return scoring.top(b.withColumn("score", F.coalesce(score, F.lit(0.0))), "score", "belief_id", k)

    def recall_all(self, as_of: str, terms: list[str], limits: tuple[int, int, int] = (20, 10, 5), least: float = 0.3) -> DataFrame:
        """The best of beliefs, experiences and procedures for some terms, as one list of memories."""
        return R.unified(self.recall(as_of, terms, k=limits[0], least=least), self.all("experiences"), self.all("procedures"), terms, as_of, limits)

    def context(self, as_of: str, terms: list[str], least: float = 0.3) -> str:
        """What is remembered about some terms, as text for a language model."""
        return R.context_text(self.recall_all(as_of, terms, least=least).collect())  # at most 35 rows

    def what_do_you_know(self, subject: str) -> DataFrame:
        return B.knowledge_proof(B.by_entity(self.beliefs(), subject))

    def contradictions(self) -> DataFrame:
        return B.contradiction_groups(self.beliefs())

    def graph(self) -> GraphQuery:
        return GraphQuery(self.beliefs().select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("edge_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")))

    # -- what is changed and forgotten ----------------------------------------------------------

    def set_privacy(self, belief_id: str, level: str, updated_us: int) -> int:
        """Change a belief's privacy, if the principal owns it or is an admin; returns how many rows changed."""
        mine = G.own(self.get("beliefs", belief_id), self.who).withColumns({"privacy_level": F.lit(level), "updated_us": F.lit(updated_us)})
        return self._put(mine)

    def share(self, belief_id: str, user: str, updated_us: int) -> int:
        mine = G.own(self.get("beliefs", belief_id), self.who)
        shared = access.share(F.coalesce("shared_with", F.array().cast("array<string>")), user)
        return self._put(mine.withColumns({"shared_with": shared, "updated_us": F.lit(updated_us)}))

    def _put(self, rows: DataFrame) -> int:
        n = rows.count()
        if n:
            files.append(rows, f"{self.path}/beliefs", schema=files.BELIEFS)
        return n

    def forget(self, chosen: Column, updated_us: int) -> int:
        """Append tombstones for what is chosen and owned; returns how many."""
        return self._put(G.forgotten(self.beliefs(), chosen, self.who).withColumns({"deleted": F.lit(True), "updated_us": F.lit(updated_us)}))

    #: What a request to forget looks at in each kind of memory: its key, session, moment and text.
    FORGETTABLE = {
        "beliefs": ("belief_id", "source_id", "observed_at", described), "experiences": ("experience_id", "session_id", "occurred_at", lambda t: t.content),
        "procedures": ("procedure_id", "procedure_id", None, lambda t: F.concat_ws(" ", t.name, t.description)), "decisions": ("decision_id", "decision_id", "decided_at", lambda t: F.concat_ws(" ", t.title, t.description)),
    }

    def forget_counts(self, request: G.ForgetRequest, updated_us: int) -> tuple[int, int, str]:
        """Carry out a request over all kinds of memory and say so in the audit log: (forgotten, failed, status).

        Rows that the principal may see but doesn't own are not forgotten and count as failed.
        """
        if problems := request.problems():
            raise ValueError("; ".join(problems))
        done = failed = 0
        for table, (key, session, at, text) in self.FORGETTABLE.items():
            rows = self.all(table)
            if (at is None and request.scope == "time_range") or (session == key and request.scope == "session"):
                continue
            meant = rows.filter(F.coalesce(request.chosen(at, entity=key, session=session, text=text(rows)), F.lit(False)))
            mine = G.own(meant, self.who)
            total, n = meant.count(), mine.count()
            if n:
                gone = materialise(mine.withColumns({"deleted": F.lit(True), "updated_us": F.lit(updated_us)}), "forgotten")
                files.append(gone, f"{self.path}/{table}", schema=files.TABLES[table][0])
            done, failed = done + n, failed + total - n
        status = "completed" if not failed else "partially_completed" if done else "failed"
        self.log(f"forget_{request.scope}", updated_us, success=status != "failed", resource=request.scope, details=f"{done} deleted, {failed} failed")
        return done, failed, status

    def forget_request(self, request: G.ForgetRequest, updated_us: int) -> str:
        """:meth:`forget_counts`, its status alone."""
        return self.forget_counts(request, updated_us)[2]

    def log(self, action: str, at_us: int, success: bool = True, resource: str | None = None, details: str | None = None) -> None:
        """Append an entry to the audit log, at the action's default severity."""
        one = self.spark.range(1).select(F.lit(action).alias("action"), F.lit(success).alias("success"))
        entry = one.select(
            F.concat(F.lit(f"{at_us}-"), F.expr("uuid()")).alias("id"), F.expr(f"timestamp_micros({at_us})").cast("timestamp_ntz").alias("ts"), F.lit(self.who.tenant_id).alias("tenant_id"), F.lit(self.who.user_id).alias("user_id"),
            "action", access.default_severity(F.col("action"), F.col("success")).alias("severity"), "success", F.lit(resource).alias("resource"), F.lit(details).alias("details"),
        )
        files.append(entry, f"{self.path}/audit", schema=files.AUDIT)

    def audit(self, **how) -> DataFrame:
        return G.audit_filter(self.all("audit"), self.who, **how)
