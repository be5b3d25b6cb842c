"""Base views: the knowledge tables that every operator reads, projected from the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def numbered(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def suppliers_named(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of supplier keys by name, the smaller name first: keys are counted, names are put on last."""
    a, b = numbered("supplier:", F.col("a")), numbered("supplier:", F.col("b"))
    return pairs.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One belief for each order line: a part is supplied by a supplier, with a confidence."""
    c, li = F.col, table(spark, sf_dir, "lineitem")
    cents = F.round(c("l_extendedprice") * 100).cast("long")
    return li.select(
        F.concat_ws("-", *[c(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], cents.cast("string")).alias("belief_id"),
        numbered("part:", c("l_partkey")).alias("subject"),
        F.lit("supplied_by").alias("predicate"),
        numbered("supplier:", c("l_suppkey")).alias("object"),
        (c("l_quantity") / 50).alias("confidence"),
        c("l_shipdate").alias("observed_at"),
        F.when(c("l_returnflag") == "R", "rejected").when(c("l_returnflag") == "A", "contested").otherwise("validated").alias("status"),
        c("l_linestatus").alias("source_id"),
        numbered("u", c("l_suppkey") % 10).alias("owner_id"),
        numbered("t", c("l_suppkey") % 4).alias("tenant_id"),
        F.when(c("l_linenumber") % 3 == 0, "private").when(c("l_linenumber") % 3 == 1, "workspace").otherwise("public").alias("privacy_level"),
        F.array(numbered("u", c("l_partkey") % 10)).alias("shared_with"),
        F.when(c("l_linenumber") % 2 == 0, c("l_shipdate")).alias("valid_from"),
        F.when(c("l_linenumber") % 5 == 0, c("l_shipdate") + F.expr("INTERVAL '400' DAY")).alias("valid_until"),
        F.when(c("l_linenumber") % 4 == 0, F.lit(86400 * 900)).alias("ttl_seconds"),
        c("l_orderkey").alias("order_id"),
        c("l_linenumber").alias("line"),
    )


def pair_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs by distinct (part, supplier): what contradiction and inference operators read."""
    b = beliefs(spark, sf_dir)
    pairs = b.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence"))
    return pairs.withColumn("belief_id", F.concat_ws("|", "subject", "object"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and purchases: customers in nations, nations in regions, orders by customers."""
    customer, nation, region, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    one = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        numbered("customer:", F.col("c_custkey")).alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"),
        (0.5 + (F.col("c_custkey") % 50) / 100).alias("confidence"))
    two = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("subject"), F.lit("part_of").alias("predicate"), F.col("r_name").alias("object"), F.lit(0.9).alias("confidence"))
    three = orders.select(
        numbered("order:", F.col("o_orderkey")).alias("subject"), F.lit("placed_by").alias("predicate"), numbered("customer:", F.col("o_custkey")).alias("object"),
        (0.6 + (F.col("o_orderkey") % 40) / 100).alias("confidence"))
    every = one.unionByName(two).unionByName(three)
    return every.withColumn("belief_id", F.concat_ws("|", "subject", "predicate", "object"))


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as experiences of a user."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("experience_id"),
        kind.alias("content"),
        F.col("ts").alias("occurred_at"),
        F.col("user_id").alias("session_id"),
        F.when(kind.isin("purchase", "signup"), "success").when(kind == "error", "failure").alias("outcome"),
        F.col("user_id").cast("string").alias("owner_id"),
        numbered("t", F.col("user_id") % 4).alias("tenant_id"),
        (F.col("event_id") % 3 == 0).alias("processed"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def working(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to working memory: one key for each kind of event, each with its own life."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("owner_id"), F.col("event_type").alias("key"), F.col("value"), micros(F.col("ts")).alias("written_us"), F.col("event_id").alias("write_id"),
        (micros(F.col("ts")) + (F.col("event_id") % 10 + 1) * 300_000_000).alias("expires_us"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an audit log."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts"), numbered("u", F.col("user_id")).alias("user_id"), numbered("t", F.col("user_id") % 4).alias("tenant_id"), kind.alias("action"),
        F.when(kind == "error", "error").when(kind == "purchase", "warning").when(kind == "signup", "info").otherwise("debug").alias("severity"), (kind != "error").alias("success"),
    )


def assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions are orders; their assumptions are their lines, as trusted then."""
    b = beliefs(spark, sf_dir)
    return b.select(F.col("order_id").alias("decision_id"), "belief_id", "subject", F.col("confidence").alias("confidence_then"), (F.col("line") == 1).alias("critical"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("edge_type"), "confidence")


#: The same views for the SQL side.
SQL = {
    "beliefs": """beliefs as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) belief_id,
  'part:' || l_partkey subject, 'supplied_by' predicate, 'supplier:' || l_suppkey object, l_quantity / 50 confidence, l_shipdate observed_at,
  case l_returnflag when 'R' then 'rejected' when 'A' then 'contested' else 'validated' end status, l_linestatus source_id, 'u' || (l_suppkey % 10) owner_id, 't' || (l_suppkey % 4) tenant_id,
  case l_linenumber % 3 when 0 then 'private' when 1 then 'workspace' else 'public' end privacy_level, ['u' || (l_partkey % 10)] shared_with,
  case when l_linenumber % 2 = 0 then l_shipdate end valid_from, case when l_linenumber % 5 = 0 then l_shipdate + interval 400 day end valid_until,
  case when l_linenumber % 4 = 0 then 86400 * 900 end ttl_seconds, l_orderkey order_id, l_linenumber line from lineitem)""",
    "pairs": """pairs as (select subject, predicate, object, max(confidence) confidence, count(*) evidence, subject || '|' || object belief_id from beliefs group by all)""",
    "triples": """t0 as (select 'customer:' || c_custkey subject, 'located_in' predicate, n_name object, 0.5 + (c_custkey % 50) / 100 confidence from customer join nation on c_nationkey = n_nationkey
  union all select n_name, 'part_of', r_name, 0.9 from nation join region on n_regionkey = r_regionkey
  union all select 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, 0.6 + (o_orderkey % 40) / 100 from orders),
 triples as (select *, concat_ws('|', subject, predicate, object) belief_id from t0)""",
    "experiences": """experiences as (select event_id experience_id, event_type content, ts occurred_at, user_id session_id, case when event_type in ('purchase', 'signup') then 'success' when event_type = 'error' then 'failure' end outcome,
  cast(user_id as varchar) owner_id, 't' || (user_id % 4) tenant_id, event_id % 3 = 0 processed, coalesce(value, 0.0) "value" from events)""",
    "working": """working as (select user_id owner_id, event_type "key", value, epoch_us(ts) written_us, event_id write_id, epoch_us(ts) + (event_id % 10 + 1) * 300000000 expires_us from events)""",
    "audit": """audit as (select event_id id, ts, 'u' || user_id user_id, 't' || (user_id % 4) tenant_id, event_type action, case event_type when 'error' then 'error' when 'purchase' then 'warning' when 'signup' then 'info' else 'debug' end severity, event_type <> 'error' success from events)""",
    "assumptions": """assumptions as (select order_id decision_id, belief_id, subject, confidence confidence_then, line = 1 critical from beliefs)""",
    "edges": """edges as (select subject src, object dst, predicate edge_type, confidence from triples)""",
}
_NEEDS = {"pairs": ["beliefs"], "assumptions": ["beliefs"], "edges": ["triples"]}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front; a body that starts with a comma adds views of its own."""
    out: list[str] = []
    for n in names.split():
        out += [x for x in (*_NEEDS.get(n, ()), n) if x not in out]
    recursive = "recursive " if "recursive_" in body else ""
    return f"with {recursive}" + ",\n ".join(SQL[n] for n in out) + body.removeprefix("" if out else ", ")
