"""Tables in and out: columnar files, JSON lines, and the append log that stands for an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OWNED = "tenant_id string, owner_id string, tags array<string>, privacy_level string, shared_with array<string>, deleted boolean, updated_us bigint"
#: Explicit schemas: nothing is inferred, and bad rows keep their text in ``_corrupt``.
BELIEFS = f"belief_id string, content string, subject string, predicate string, object string, confidence double, status string, source_id string, observed_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, ttl_seconds int, {_OWNED}"
EXPERIENCES = f"experience_id string, content string, outcome string, session_id string, causal_parent string, occurred_at timestamp_ntz, processed boolean, {_OWNED}"
PROCEDURES = f"procedure_id string, name string, description string, `trigger` string, steps array<string>, confidence double, successes bigint, failures bigint, {_OWNED}"
DECISIONS = f"decision_id string, title string, description string, status string, assumptions array<struct<belief_id: string, description: string, confidence_at_decision: double, is_critical: boolean>>, revision_of string, outcome string, decided_at timestamp_ntz, {_OWNED}"
SNAPSHOTS = f"snapshot_id string, task_context string, summary string, next_steps array<string>, open_questions array<string>, working_memory map<string,string>, belief_ids array<string>, taken_at timestamp_ntz, {_OWNED}"
EDGES = f"src string, dst string, edge_type string, weight double, confidence double, description string, embedding array<float>, {_OWNED}"
RULES = "rule_id string, kind string, entity_type string, pattern string, template string, confidence double, description string, deleted boolean, updated_us bigint"
AUDIT = "id string, ts timestamp_ntz, tenant_id string, user_id string, action string, severity string, success boolean, resource string, details string"
#: Tables of a store: schema, key, and the table's time.
TABLES = {
    "beliefs": (BELIEFS, "belief_id"), "experiences": (EXPERIENCES, "experience_id"), "procedures": (PROCEDURES, "procedure_id"), "decisions": (DECISIONS, "decision_id"),
    "snapshots": (SNAPSHOTS, "snapshot_id"), "edges": (EDGES, ""), "rules": (RULES, "rule_id"), "audit": (AUDIT, ""),
}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def append(df: DataFrame, path: str, *by: str, schema: str | None = None) -> None:
    """Append to a table that is laid out by tenant (or other columns of few values), in the columns and types of its schema."""
    if schema is not None:
        df = df.sparkSession.createDataFrame([], schema).unionByName(df, allowMissingColumns=True).to(df.sparkSession.createDataFrame([], schema).schema)
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def latest(spark: SparkSession, path: str, key: str, *order: str, schema: str) -> DataFrame:
    """The table that an append log stands for."""
    from lorebase.operators.governance import upserted

    return upserted(spark.read.schema(schema).parquet(path), key, *order)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("errorifexists").format(kind).save(path)
