"""The named queries over the engine's own operators, each with its SQL.

Every query reads whole tables.  Fixed parameters: the moments below, and principal u3 of t3.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions import access, scoring, temporal
from lorebase.operators import beliefs as B
from lorebase.operators import governance as G
from lorebase.operators import graph
from lorebase.operators import reflection as R
from lorebase.operators import retrieval as S
from lorebase.operators import text as T
from lorebase.plans import views as V
from lorebase.plans.views import with_views
from lorebase.storage import materialise

ORDERS_AT, EVENTS_AT, HALF = "2002-01-01 00:00:00", "2024-01-31 00:00:00", 365
WHO = access.Principal("u3", "t3", ("member",))
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return keep


def _load() -> None:
    """The queries that stand in modules of their own."""
    from lorebase import catalogue_engine, catalogue_store, catalogue_text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def r6(c) -> F.Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def acl(df: DataFrame) -> F.Column:
    return access.visible(WHO, df.owner_id, df.tenant_id, df.privacy_level, df.shared_with)


AGE = f"(epoch_us(timestamp '{ORDERS_AT}') - epoch_us(observed_at)) / 1e6"
DECAY = f"greatest(0.1, least(1.0, pow(0.5, {AGE} / ({HALF} * 86400.0))))"
SEES = "case when owner_id = 'u3' then true when tenant_id <> 't3' then privacy_level = 'public' when privacy_level in ('public', 'workspace') then true else list_contains(shared_with, 'u3') end"

# -- beliefs in time and under access -----------------------------------------------------------


@query("belief_decayed_topk", with_views("beliefs", f"select belief_id, subject, object, round(confidence * {DECAY}, 6) trust from beliefs where {SEES} and status not in ('rejected', 'contested') and confidence >= 0.3 and (valid_from is null or valid_from <= timestamp '{ORDERS_AT}') and (valid_until is null or timestamp '{ORDERS_AT}' <= valid_until) order by trust desc, belief_id limit 10"))
def belief_decayed_topk(spark, d):
    b = V.beliefs(spark, d)
    b = b.filter(acl(b) & ~b.status.isin("rejected", "contested") & (F.coalesce(b.confidence, F.lit(1.0)) >= 0.3) & temporal.valid_at(b.valid_from, b.valid_until, ORDERS_AT))
    trust = b.confidence * temporal.decay(temporal.age_seconds(b.observed_at, ORDERS_AT), half_life_days=HALF)
    return scoring.top(b.select("belief_id", "subject", "object", r6(trust).alias("trust")), "trust", "belief_id", 10)


def _decays(kind, expression):
    @query(f"decay_{kind}", with_views("beliefs", f"select status, count(*) n, round(avg({expression}), 6) factor, round(avg(confidence * {expression}), 6) left_over from beliefs group by status"))
    def run(spark, d):
        b = V.beliefs(spark, d)
        f = temporal.decay(temporal.age_seconds(b.observed_at, ORDERS_AT), kind, HALF)
        return b.groupBy("status").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(f)).alias("factor"), r6(F.avg(b.confidence * f)).alias("left_over"))


_decays("linear", f"greatest(0.1, least(1.0, 1 - {AGE} / (2 * {HALF} * 86400.0)))")
_decays("exponential", DECAY)
_decays("step", f"greatest(0.1, least(1.0, case when {AGE} >= {HALF} * 86400.0 then 0.5 else 1.0 end))")
_decays("none", "1.0")


@query("effective_confidence", with_views("beliefs", f"select source_id, round(avg(greatest(0.0, least(1.0, confidence * {DECAY} + 0.05))), 6) confidence from beliefs group by source_id"))
def effective(spark, d):
    b = V.beliefs(spark, d)
    c = temporal.effective_confidence(b.confidence, temporal.age_seconds(b.observed_at, ORDERS_AT), 0.05, half_life_days=HALF)
    return b.groupBy("source_id").agg(r6(F.avg(c)).alias("confidence"))


@query("belief_validity_check", with_views("beliefs", f""", r as (select *, case when not ((valid_from is null or valid_from <= timestamp '{ORDERS_AT}') and (valid_until is null or timestamp '{ORDERS_AT}' <= valid_until)) then 'out_of_bounds'
 when ttl_seconds is not null and {AGE} > ttl_seconds then 'expired' when {AGE} > 30 * 86400 then 'stale' else 'valid' end reason from beliefs)
 select belief_id, reason, reason in ('valid', 'stale') is_valid, round(case when reason in ('out_of_bounds', 'expired') then 0.0 else confidence * {DECAY} end, 6) confidence from r"""))  # fmt: skip
def validity(spark, d):
    b = V.beliefs(spark, d)
    v = temporal.validity(b.confidence, b.observed_at, b.valid_from, b.valid_until, b.ttl_seconds, ORDERS_AT, half_life_days=HALF)
    return b.select("belief_id", v.alias("v")).select("belief_id", "v.reason", "v.is_valid", r6(F.col("v.confidence")).alias("confidence"))


@query("needs_verification", with_views("beliefs", f"select status, count(*) n from beliefs where {AGE} > 1000 * 86400.0 / 2 group by status"))
def needs(spark, d):
    b = V.beliefs(spark, d)
    return b.filter(temporal.needs_verification(b.observed_at, ORDERS_AT, 1000)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("acl_visible_items", with_views("beliefs", f"select privacy_level, tenant_id, count(*) n from beliefs where {SEES} group by all"))
def acl_items(spark, d):
    b = V.beliefs(spark, d)
    return b.filter(acl(b)).groupBy("privacy_level", "tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query("abac_decisions", with_views("beliefs", """, p as (select case when owner_id = 'u3' then 'owner' when tenant_id <> 't3' and privacy_level <> 'public' then 'other_tenant' when privacy_level = 'public' then 'public_read'
 when tenant_id = 't3' and privacy_level = 'workspace' then 'workspace_read' when list_contains(shared_with, 'u3') then 'shared_read' else 'default' end policy from beliefs)
 select policy, policy not in ('other_tenant', 'default') allowed, count(*) n from p group by all"""))  # fmt: skip
def abac(spark, d):
    b = V.beliefs(spark, d)
    v = access.decided(access.default_policies(WHO, "read", b.owner_id, b.tenant_id, b.privacy_level, b.shared_with))
    return b.select(v.alias("v")).groupBy("v.policy", "v.allowed").agg(F.count(F.lit(1)).alias("n"))


@query("preferences_gate", "select lang, count(*) n from documents where not contains(lower(text), 'token') and not contains(lower(text), 'fr') and not regexp_matches(text, '(?i)[0-9]{16}') and lang <> 'fr' group by lang")
def preferences(spark, d):
    docs = V.table(spark, d, "documents")
    p = access.Preferences(blocked_topics=["Token", "FR"], blocked_patterns=["[0-9]{16}"])
    kept = docs.withColumn("tags", F.array("lang")).filter(access.may_remember(p, F.col("text"), F.col("tags")))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("pii_scan", "select lang, count(*) filter (regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')) ssn, count(*) filter (regexp_matches(text, '[0-9]{16}')) card, count(*) filter (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) email from documents group by lang")
def pii_scan(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.groupBy("lang").agg(*[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in access.PII.items()])


@query("consent_share_maps", with_views("beliefs", "select belief_id, list_contains(list_append(shared_with, 'u3'), 'u3') now_shared, len(list_distinct(list_append(shared_with, 'u3'))) partners, len(list_filter(shared_with, lambda x: x <> 'u1')) after_unshare, line % 2 = 1 consents from beliefs"))
def consent(spark, d):
    b = V.beliefs(spark, d)
    granted = access.grant(F.create_map(F.lit("analytics"), F.col("observed_at")), "training", F.col("observed_at"))
    # Of every second line the consent is taken back again.
    left = F.when(b.line % 2 == 1, access.revoke(granted, "analytics")).otherwise(access.revoke(granted, "training"))
    return b.select("belief_id", F.array_contains(access.share(b.shared_with, "u3"), "u3").alias("now_shared"), F.size(access.share(b.shared_with, "u3")).cast("long").alias("partners"),
                    F.size(access.unshare(b.shared_with, "u1")).cast("long").alias("after_unshare"), F.map_contains_key(left, "training").alias("consents"))


@query("retention_days", with_views("beliefs", "select least(coalesce(case when line % 2 = 0 then line * 40 end, 30), 90) as days, count(*) n from beliefs group by all"))
def retention(spark, d):
    b = V.beliefs(spark, d)
    days = access.retention_days(access.Preferences.private(), F.when(b.line % 2 == 0, b.line * 40))
    return b.groupBy(days.cast("int").alias("days")).agg(F.count(F.lit(1)).alias("n"))


@query("beliefs_by_entity", with_views("beliefs", "select belief_id, subject, object from beliefs where subject = 'part:7' or object = 'part:7' union select belief_id, subject, object from beliefs where subject = 'supplier:3' or object = 'supplier:3'"))
def by_entity(spark, d):
    b = V.beliefs(spark, d).select("belief_id", "subject", "object")
    return B.by_entity(b, "part:7").unionByName(B.by_entity(b, "supplier:3")).distinct()


# -- experiences, working memory, procedures ----------------------------------------------------


@query("recent_experiences", with_views("experiences", f"select experience_id, content, epoch_us(occurred_at) occurred_us from experiences where occurred_at >= timestamp '{EVENTS_AT}' - interval 72 hour and occurred_at <= timestamp '{EVENTS_AT}' order by occurred_at desc, experience_id limit 100"))
def recent(spark, d):
    e, now = V.experiences(spark, d), temporal.at(EVENTS_AT)
    e = e.filter((e.occurred_at >= now - F.expr("INTERVAL '72' HOUR")) & (e.occurred_at <= now)).orderBy(e.occurred_at.desc(), "experience_id").limit(100)
    return e.select("experience_id", "content", V.micros(e.occurred_at).alias("occurred_us"))


@query("unprocessed_experiences", with_views("experiences", "select experience_id, content from experiences where not processed order by occurred_at, experience_id limit 50"))
def unprocessed(spark, d):
    return V.experiences(spark, d).filter("not processed").orderBy("occurred_at", "experience_id").limit(50).select("experience_id", "content")


NOW_US = f"epoch_us(timestamp '{EVENTS_AT}')"


@query("working_latest_unexpired", with_views("working", f""", l as (select *, row_number() over (partition by owner_id, "key" order by written_us desc, write_id desc) rn from working where written_us <= {NOW_US} - 86400000000)
 select owner_id, "key", value from l where rn = 1 and expires_us >= {NOW_US} - 86400000000"""))  # fmt: skip
def working_latest(spark, d):
    now = V.micros(temporal.at(EVENTS_AT)) - 86_400_000_000
    w = V.working(spark, d).filter(F.col("written_us") <= now)
    last = w.withColumn("rn", F.row_number().over(Window.partitionBy("owner_id", "key").orderBy(F.col("written_us").desc(), F.col("write_id").desc())))
    return last.filter((F.col("rn") == 1) & (F.col("expires_us") >= now)).select("owner_id", "key", "value")


@query("working_cleanup_count", with_views("working", f'select "key", count(*) expired from working where expires_us < {NOW_US} group by all'))
def working_cleanup(spark, d):
    return V.working(spark, d).filter(F.col("expires_us") < V.micros(temporal.at(EVENTS_AT))).groupBy("key").agg(F.count(F.lit(1)).alias("expired"))


@query("procedure_success", """with p as (select l_partkey, count(*) filter (l_returnflag = 'N') good, count(*) filter (l_returnflag = 'R') bad from lineitem group by l_partkey),
 r as (select 'part:' || l_partkey procedure_id, good, bad, case when good + bad = 0 then 0.5 else good / (good + bad) end rate from p)
 select procedure_id, good, bad, round(rate, 6) rate, round(0.3 + 0.6 * rate, 6) confidence, round((0.3 + 0.6 * rate) * rate, 6) relevance from r order by relevance desc, procedure_id limit 20""")  # fmt: skip
def procedures(spark, d):
    p = V.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("good"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    rate = F.when(F.col("good") + F.col("bad") == 0, 0.5).otherwise(F.col("good") / (F.col("good") + F.col("bad")))
    p = p.withColumn("r", rate).withColumn("c", 0.3 + 0.6 * F.col("r"))
    p = p.select(V.numbered("part:", F.col("l_partkey")).alias("procedure_id"), "good", "bad", r6(F.col("r")).alias("rate"), r6(F.col("c")).alias("confidence"), r6(F.col("c") * F.col("r")).alias("relevance"))
    return scoring.top(p, "relevance", "procedure_id", 20)


# -- retrieval ----------------------------------------------------------------------------------

NATS = "case when confidence <= 0 or confidence >= 1 then 0.0 else -(confidence * ln(confidence) + (1 - confidence) * ln(1 - confidence)) end"


@query("entropy_uncertain", with_views("pairs", f"select belief_id, round(({NATS}) / ln(2.0), 6) bits from pairs where ({NATS}) / ln(2.0) >= 0.5 order by bits desc, belief_id limit 50"))
def uncertain(spark, d):
    p = V.pair_beliefs(spark, d)
    bits = scoring.entropy(F.col("confidence"), True)
    return scoring.top(p.filter(bits >= 0.5).select("belief_id", r6(bits).alias("bits")), "bits", "belief_id", 50)


def _rerank(direction):
    e = f"least(({NATS}) / 0.693, 1.0)"
    @query(f"entropy_rerank_{direction}", with_views("pairs", f"select belief_id, round(confidence * 0.7 + {e if direction == 'high' else '(1 - ' + e + ')'} * 0.3, 6) score from pairs order by score desc, belief_id limit 30"))
    def run(spark, d):
        p = V.pair_beliefs(spark, d)
        s = scoring.reranked(F.col("confidence"), scoring.entropy(F.col("confidence")), 0.3, direction)
        return scoring.top(p.select("belief_id", r6(s).alias("score")), "score", "belief_id", 30)


_rerank("low")
_rerank("high")


COS = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


def _vectors(spark, d):
    e = V.table(spark, d, "embeddings")
    q = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return e.crossJoin(q).select(F.col("vec_id").alias("doc_id"), scoring.cosine(F.col("embedding"), F.col("q")).alias("score"))


@query("vector_knn", f"select e.vec_id doc_id, round({COS}, 6) score from embeddings e, embeddings q where q.vec_id = 0 order by score desc, doc_id limit 10")
def knn(spark, d):
    return scoring.top(_vectors(spark, d).withColumn("score", r6(F.col("score"))), "score", "doc_id", 10)


TERMS = ["the", "erst", "token", "que"]
BM25 = """words as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') ws from documents),
 dl as (select doc_id, len(ws) dl, ws from words), corpus as (select count(*) n, avg(dl) a from dl),
 tf as (select doc_id, dl, term, count(*) tf from (select doc_id, dl, unnest(ws) term from dl) where term in ('the', 'erst', 'token', 'que') group by all),
 df as (select term, count(*) df from tf group by term),
 bm as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) score from tf join df using (term), corpus group by doc_id)"""


@query("bm25_search", f"with {BM25} select doc_id, round(score, 6) score from bm order by score desc, doc_id limit 20")
def bm25(spark, d):
    s = scoring.bm25(V.table(spark, d, "documents"), TERMS, "doc_id", "text")
    return scoring.top(s.withColumn("score", r6(F.col("score"))), "score", "doc_id", 20)


@query("temporal_search", with_views("beliefs", f"select belief_id, round(0.1 * confidence + 0.9 * exp(-0.6931471805599453 * ({AGE} / 3600) / 8760), 6) score from beliefs order by score desc, belief_id limit 20"))
def temporal_search(spark, d):
    b = V.beliefs(spark, d)
    signals = {"confidence": b.confidence, "temporal": scoring.temporal(temporal.age_seconds(b.observed_at, ORDERS_AT) / 3600, 8760)}
    return scoring.top(b.select("belief_id", r6(scoring.weighted(signals, {"confidence": 0.1, "temporal": 0.9})).alias("score")), "score", "belief_id", 20)


#: Rounds of the walk that tells how near documents are: by their source, from the five that the text finds first.
WALK = 4
LINKS = "l as (select 'doc:' || doc_id src, 'source:' || source dst from documents), e as (select src, dst from l union select dst, src from l), od as (select src, count(*) o from e group by src)"


def _near_sql() -> str:
    sql = f"{LINKS}, seed as (select 'doc:' || doc_id node from bm order by round(score, 6) desc, doc_id limit 5), r0 as materialized (select src node, o, case when src in (select node from seed) then 1.0 / (select count(*) from seed) else 0.0 end home from od), w0 as (select node, home rk from r0)"
    for i in range(WALK):
        sql += f", w{i + 1} as materialized (select r0.node, 0.85 * coalesce(flow, 0) + 0.15 * home rk from r0 left join (select dst node, sum(rk / o) flow from w{i} join e on src = w{i}.node join od using (src) group by dst) using (node))"
    return sql + f", near as (select node, rk / (select max(rk) from w{WALK}) near from w{WALK})"


HYBRID = f"""{BM25}, {_near_sql()}, v as (select e.vec_id doc_id, {COS} vec from embeddings e, embeddings q where q.vec_id = 0), m as (select max(score) top from bm),
 s as (select d.doc_id, coalesce(vec, 0) vec, coalesce(score, 0) / top txt, exp(-0.6931471805599453 * (d.doc_id % 60) / H) tmp, 0.5 + (d.doc_id % 50) / 100 confidence, near from documents d left join v on v.doc_id = d.doc_id left join bm on bm.doc_id = d.doc_id join near on near.node = 'doc:' || d.doc_id, m)"""


def _signals(spark, d, half_life_days):
    docs = V.table(spark, d, "documents")
    text = materialise(scoring.bm25(docs, TERMS, "doc_id", "text").withColumnRenamed("score", "txt"), "hybrid-text")
    best = F.broadcast(text.agg(F.max("txt").alias("top")))  # one row
    seeds = S.seeded(text.select(r6(F.col("txt")).alias("score"), "doc_id", V.numbered("doc:", F.col("doc_id")).alias("node")), "node", "doc_id")
    links = docs.select(V.numbered("doc:", F.col("doc_id")).alias("src"), F.concat(F.lit("source:"), "source").alias("dst"))
    near = S.nearness(links, seeds, WALK).withColumn("_node", F.col("node")).drop("node")
    out = docs.select("doc_id").join(_vectors(spark, d).withColumnRenamed("score", "vec"), "doc_id", "left").join(text, "doc_id", "left")
    out = out.join(near, V.numbered("doc:", F.col("doc_id")) == F.col("_node")).crossJoin(best).withColumn("confidence", 0.5 + (F.col("doc_id") % 50) / 100)
    signals = {"vector": F.col("vec"), "text": F.col("txt") / F.col("top"), "temporal": scoring.temporal((F.col("doc_id") % 60) * 24.0, half_life_days * 24.0), "confidence": F.col("confidence"), "graph": F.col("near")}
    return out, signals


def _hybrid(name):
    p = scoring.PROFILES[name]
    fused = f"({p.vector} * vec + {p.text} * txt + {p.temporal} * tmp + {p.confidence} * confidence + {p.graph} * near)"
    e = f"least(({NATS}) / 0.693, 1.0)"
    sql = f"with {HYBRID.replace('H)', f'{p.half_life_days})')} select doc_id, round({fused} * {1 - p.entropy} + {e if p.direction == 'high' else '(1 - ' + e + ')'} * {p.entropy}, 6) score from s order by score desc, doc_id limit 20"
    @query(f"hybrid_weighted_{name}", sql)
    def run(spark, d):
        out, signals = _signals(spark, d, p.half_life_days)
        score = scoring.reranked(scoring.weighted(signals, p.weights()), scoring.entropy(F.col("confidence")), p.entropy, p.direction)
        return scoring.top(out.select("doc_id", r6(score).alias("score")), "score", "doc_id", 20)


for _name in scoring.PROFILES:
    _hybrid(_name)


@query("hybrid_rrf", f"""with {BM25}, v as (select e.vec_id doc_id, round({COS}, 9) score from embeddings e, embeddings q where q.vec_id = 0), r as (
 select doc_id, 1.0 / (60 + row_number() over (order by score desc, doc_id)) part from v union all select doc_id, 0.5 / (60 + row_number() over (order by round(score, 9) desc, doc_id)) from bm)
 select doc_id, round(sum(part), 6) score from r group by doc_id order by score desc, doc_id limit 20""")  # fmt: skip
def rrf(spark, d):
    text = scoring.bm25(V.table(spark, d, "documents"), TERMS, "doc_id", "text").withColumn("score", F.round("score", 9))
    s = scoring.fuse_ranks({"v": _vectors(spark, d).withColumn("score", F.round("score", 9)), "t": text}, "doc_id", {"v": 1.0, "t": 0.5})
    return scoring.top(s.withColumn("score", r6(F.col("score"))), "score", "doc_id", 20)


PROCEDURES = """procedures as (select 'part:' || l_partkey id, any_value(p_name) nm, count(*) filter (l_returnflag = 'N') good, count(*) filter (l_returnflag = 'R') bad, any_value(p_type) ty, any_value(p_brand) br from lineitem join part on p_partkey = l_partkey group by l_partkey)"""


def _procedures(spark, d):
    p = V.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("successes"), F.count_if(F.col("l_returnflag") == "R").alias("failures"))
    p = p.join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return p.select(V.numbered("part:", F.col("l_partkey")).alias("procedure_id"), F.col("p_name").alias("name"), F.array(F.lower("p_type"), F.lower("p_brand")).alias("steps"), F.lit(0.8).alias("confidence"), "successes", "failures")


@query("unified_recall", with_views("pairs experiences working", f""", {PROCEDURES}, live as (select *, row_number() over (partition by owner_id, "key" order by written_us desc, write_id desc) rn from working where written_us <= {NOW_US} - 86400000000), every as (
 select 'belief' memory_type, belief_id id, confidence score, '(' || subject || ', ' || predicate || ', ' || object || ')' content from pairs where confidence >= 0.3
 union all select 'experience', cast(experience_id as varchar), greatest(0.0, 1 - ({NOW_US} - epoch_us(occurred_at)) / 3.6e9 / 168), content || coalesce(' → ' || outcome, '') from experiences
 union all select 'procedure', id, 0.8 * case when good + bad = 0 then 0.5 else good / (good + bad) end, nm || ': ' || lower(ty) || ' → ' || lower(br) from procedures
 union all select 'working', "key", 1.0, "key" || ' = ' || cast(value as varchar) from live where rn = 1 and owner_id = 7 and expires_us >= {NOW_US} - 86400000000 - 3600000000),
 r as (select *, row_number() over (partition by memory_type order by round(score, 6) desc, id) rn from every)
 select memory_type, id, round(score, 6) score, content from r where rn <= case memory_type when 'belief' then 20 when 'experience' then 10 when 'procedure' then 5 else 50 end"""))  # fmt: skip
def recall(spark, d):
    now = V.micros(temporal.at(EVENTS_AT)) - 86_400_000_000
    w = V.working(spark, d).filter(F.col("written_us") <= now)
    last = w.withColumn("rn", F.row_number().over(Window.partitionBy("owner_id", "key").orderBy(F.col("written_us").desc(), F.col("write_id").desc())))
    live = last.filter((F.col("rn") == 1) & (F.col("owner_id") == 7) & (F.col("expires_us") >= now - 3_600_000_000))
    kinds = [S.remembered_beliefs(V.pair_beliefs(spark, d).filter("confidence >= 0.3").withColumn("score", F.col("confidence"))), S.remembered_experiences(V.experiences(spark, d), EVENTS_AT), S.remembered_procedures(_procedures(spark, d)), S.remembered_working(live)]
    every = reduce(DataFrame.unionByName, kinds).withColumn("score", r6(F.col("score")))
    return S.limited(every, {"belief": 20, "experience": 10, "procedure": 5, "working": 50})


# -- contradictions, inference, judgement -------------------------------------------------------


@query("contradiction_groups", with_views("pairs", "select lower(subject) subject, lower(predicate) predicate, count(distinct lower(object)) objects, count(*) beliefs, max(confidence) top_confidence from pairs group by 1, 2 having objects > 1"))
def groups(spark, d):
    return B.contradiction_groups(V.pair_beliefs(spark, d))


@query("contradiction_pairs", with_views("pairs", "select a.belief_id a_id, b.belief_id b_id, a.subject, round(greatest(0.0, a.confidence + b.confidence - 1), 6) score from pairs a join pairs b on a.subject = b.subject and a.belief_id < b.belief_id and a.object <> b.object"))
def pairs(spark, d):
    return B.contradiction_pairs(V.pair_beliefs(spark, d)).withColumn("score", r6(F.col("score")))


TWO = "two as (select a.belief_id id1, b.belief_id id2, a.subject s, b.object o, least(a.confidence, b.confidence) c from triples a join triples b on lower(a.object) = lower(b.subject) where a.belief_id <> b.belief_id and lower(a.subject) <> lower(b.object) and least(a.confidence, b.confidence) * 0.7 >= 0.3)"


@query("infer_two_hop", with_views("triples", f", {TWO} select id1, id2, s, o, round(c * 0.7, 6) confidence from two"))
def two_hop(spark, d):
    return B.two_hop(V.triples(spark, d)).select("id1", "id2", "s", "o", r6(F.col("confidence")).alias("confidence"))


@query("infer_three_hop", with_views("triples", f", {TWO} select id1, id2, t.belief_id id3, s, t.object o, round(least(c, t.confidence) * 0.5, 6) confidence from two join triples t on lower(two.o) = lower(t.subject) where t.belief_id not in (id1, id2) and lower(s) <> lower(t.object) and least(c, t.confidence) * 0.5 >= 0.3"))
def three_hop(spark, d):
    return B.three_hop(V.triples(spark, d)).withColumn("confidence", r6(F.col("confidence")))


@query("infer_dedupe", with_views("triples", f", {TWO}, r as (select *, row_number() over (partition by lower(s), lower(o) order by c desc, id1, id2) rn from two) select s, o, round(c * 0.7, 6) confidence from r where rn = 1"))
def dedupe(spark, d):
    return B.best_inferred(B.two_hop(V.triples(spark, d))).select("s", "o", r6(F.col("confidence")).alias("confidence"))


#: What is said of orders and their parts: numbers, truths and places, some of them against each other.
SAID = """said as (select 'part:' || l_partkey subject, 'line' predicate, cast(l_linenumber as varchar) object, l_orderkey k from lineitem
 union all select 'part:' || l_partkey, 'returned', case when l_returnflag = 'R' then 'true' else 'false' end, l_orderkey from lineitem
 union all select 'order:' || l_orderkey, 'holds', 'part:' || l_partkey, l_orderkey from lineitem)"""


def _said(spark, d):
    li = V.table(spark, d, "lineitem")
    part, k = V.numbered("part:", F.col("l_partkey")).alias("subject"), F.col("l_orderkey").alias("k")
    lines = li.select(part, F.lit("line").alias("predicate"), F.col("l_linenumber").cast("string").alias("object"), k)
    truth = F.when(F.col("l_returnflag") == "R", "true").otherwise("false")
    held = li.select(V.numbered("order:", F.col("l_orderkey")).alias("subject"), F.lit("holds").alias("predicate"), part.alias("object"), k)
    return lines.unionByName(li.select(part, F.lit("returned").alias("predicate"), truth.alias("object"), k)).unionByName(held)


@query("backward_update_counts", f"""with {SAID}, old as (select subject || '|' || predicate || '|' || object belief_id, subject s, predicate p, object o from said where k % 3 > 0 group by all), fresh as (select subject s, predicate p, object o, count(*) n from said where k % 3 = 0 group by all),
 e as (select s, p, sum(n) n from fresh group by all), a as (select s, sum(n) n from fresh group by s)
 select belief_id, cast(coalesce(f.n, 0) as bigint) confirmed, cast(coalesce(e.n, 0) - coalesce(f.n, 0) as bigint) denied, cast(coalesce(a.n, 0) as bigint) about
 from old left join e using (s, p) left join fresh f on f.s = old.s and f.p = old.p and f.o = old.o left join a on a.s = old.o where coalesce(e.n, 0) + coalesce(a.n, 0) > 0""")  # fmt: skip
def backward(spark, d):
    said = _said(spark, d)
    old = said.filter("k % 3 > 0").select("subject", "predicate", "object").distinct().withColumn("belief_id", F.concat_ws("|", "subject", "predicate", "object"))
    return B.backward_counts(old, said.filter("k % 3 = 0"))


@query("candidate_support_contradict", f"""with {SAID}, c as (select distinct subject || '|' || predicate || '|' || object candidate_id, subject s, predicate p, object o from said where predicate <> 'holds' and k % 5 = 0), b as (select subject s, predicate p, object o, count(*) n from said where k % 5 > 0 group by all),
 j as (select candidate_id, contains(c.o, b.o) or contains(b.o, c.o) yes, (c.o = 'true' and b.o = 'false') or (c.o = 'false' and b.o = 'true') or coalesce(try_cast(c.o as double) <> try_cast(b.o as double), false) no, n from c join b using (s, p))
 select c.candidate_id, cast(coalesce(sum(n) filter (yes), 0) as bigint) supports, cast(coalesce(sum(n) filter (no and not yes), 0) as bigint) contradicts from c left join j using (candidate_id) group by 1""")  # fmt: skip
def candidates(spark, d):
    said = _said(spark, d)
    c = said.filter("predicate != 'holds' and k % 5 = 0").select("subject", "predicate", "object").distinct().withColumn("candidate_id", F.concat_ws("|", "subject", "predicate", "object"))
    return B.judged(c, said.filter("k % 5 > 0"))


@query("cross_reference", """with w as (select conv_id, turn, conv_id * 1000 + turn id, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) ws from conversations),
 s as (select *, list_has_any(ws, ['not', 'no', 'never', 'incorrect', 'wrong', 'false']) neg from w),
 p as (select a.id a_id, b.id b_id, len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) ov, a.neg <> b.neg differ from s a join s b on a.role = 'user' and b.role = 'assistant' where len(a.ws) > 0 and len(b.ws) > 0)
 select a_id, b_id, round(ov, 6) overlap, case when differ then 'contradict' else 'agree' end kind from p where ov > 0.3""")  # fmt: skip
def cross(spark, d):
    c = V.table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return B.cross_reference(c.filter("role = 'user'"), c.filter("role = 'assistant'"))


NOW = "now as (select subject, avg(confidence) c from beliefs group by subject)"


@query("decision_drift", with_views("assumptions", f", {NOW} select decision_id, round(max(abs(c - confidence_then)), 6) max_drift, 'revisit_suggested' status from assumptions join now using (subject) join orders on o_orderkey = decision_id where critical and o_orderstatus <> 'P' group by decision_id having max(abs(c - confidence_then)) > 0.2"))
def drift(spark, d):
    now = V.beliefs(spark, d).groupBy("subject").agg(F.avg("confidence").alias("confidence"))
    status = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"), F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("active").alias("status"))
    return B.drift(V.assumptions(spark, d).join(status, "decision_id"), now).withColumn("max_drift", r6(F.col("max_drift")))


@query("decision_lifecycle", """with o as (select o_orderkey decision_id, o_orderpriority title, 'active' status, cast(null as bigint) revision_of from orders)
 select decision_id, title, case when decision_id % 10 = 0 then 'superseded' else status end status, revision_of from o union all select decision_id + 100000000, title, 'active', decision_id from o where decision_id % 10 = 0""")  # fmt: skip
def lifecycle(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderpriority").alias("title"), F.lit("active").alias("status"))
    changes = o.filter("decision_id % 10 = 0").select("decision_id", (F.col("decision_id") + 100_000_000).alias("new_id"), "title")
    return G.revised(o, changes).select("decision_id", "title", "status", "revision_of")


@query("belief_as_of", with_views("beliefs", ", r as (select subject, confidence, belief_id, row_number() over (partition by subject order by observed_at desc, belief_id desc) rn from beliefs where observed_at <= timestamp '1998-06-01') select subject, belief_id entry_id, confidence from r where rn = 1"))
def as_of(spark, d):
    h = V.beliefs(spark, d).select("subject", F.col("belief_id").alias("entry_id"), "confidence", "observed_at")
    return B.as_of(h, "subject", "observed_at", F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")).select("subject", "entry_id", "confidence")


@query("as_of_join", """with h as (select user_id, ts, max(event_id) e from events where event_type = 'purchase' group by 1, 2), l as (select * from events where event_type = 'view')
 select l.event_id, h.e last_purchase from l asof left join h on l.user_id = h.user_id and l.ts >= h.ts""")  # fmt: skip
def as_of_join(spark, d):
    e = V.table(spark, d, "events")
    h = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    left = e.filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("seen"))
    # Of a view and a purchase at one instant, the purchase comes first.
    return B.as_of_join(left, h, "user_id", "seen", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query("belief_snapshot", with_views("pairs", "select 'snap-1' snapshot_id, belief_id, confidence from pairs where evidence >= 2"))
def snapshot(spark, d):
    p = V.pair_beliefs(spark, d)
    return B.snapshot(p, p.filter("evidence >= 2"), "snap-1").select("snapshot_id", "belief_id", "confidence")


@query("bayes_update", with_views("pairs", ", x as (select belief_id, 2 * confidence + evidence a, 2 * (1 - confidence) + 1 b from pairs) select belief_id, round(a / (a + b), 6) mean, round(greatest(0.0, a / (a + b) - 1.96 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) low, round(least(1.0, a / (a + b) + 1.96 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) high from x"))
def bayes(spark, d):
    p = V.pair_beliefs(spark, d)
    p = p.select("belief_id", B.bayes(F.col("confidence"), F.col("evidence"), F.lit(1)).alias("x"))
    return p.select("belief_id", *[r6(F.col(f"x.{k}")).alias(k) for k in ("mean", "low", "high")])


@query("knowledge_proof", with_views("beliefs", ", t as (select * from beliefs order by confidence desc, belief_id limit 50), g as (select count(*) contradictions from (select subject from t group by subject having count(distinct object) > 1)) select count(*) beliefs, count(distinct source_id) sources, round(avg(confidence), 6) mean_confidence, count(*) filter (status = 'contested') contested, any_value(contradictions) contradictions from t, g"))
def proof(spark, d):
    return B.knowledge_proof(scoring.top(V.beliefs(spark, d), "confidence", "belief_id", 50))


@query("verify_claim", with_views("pairs", ", c as (select subject, case when count(distinct object) > 1 then 1 else 0 end contradictions, max(confidence) best from pairs group by subject) select subject, case when contradictions > 0 then 'contested' when best >= 0.7 then 'supported' when best >= 0.5 then 'weakly_supported' else 'unsupported' end verdict from c"))
def verify(spark, d):
    c = V.pair_beliefs(spark, d).groupBy("subject").agg((F.count_distinct("object") > 1).cast("int").alias("contradictions"), F.max("confidence").alias("best"))
    return c.select("subject", B.verdict(c).alias("verdict"))


@query("brief_summary", with_views("pairs", ", t as (select * from pairs where confidence >= 0.2 order by confidence desc, belief_id limit 30), e as (select o_orderkey from orders where o_orderpriority = '1-URGENT' order by o_orderdate desc, o_orderkey desc limit 5) select count(*) facts, count(*) filter (confidence < 0.5) uncertain, round(avg(confidence), 6) avg_confidence, round(avg(1 - confidence), 6) avg_uncertainty, (select count(*) from e) precedents from t"))
def brief(spark, d):
    t = scoring.top(V.pair_beliefs(spark, d).filter("confidence >= 0.2"), "confidence", "belief_id", 30)
    return B.brief(t, S.newest(V.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), "o_orderdate", "o_orderkey", 5))


def _general(name, keys, other):
    @query(f"generalize_{name}", with_views("pairs", f"select {', '.join(f'lower({k}) {k}' for k in keys)}, count(*) members, round(avg(confidence), 6) avg_confidence, count(distinct {other}) distinct_members, min({other}) first_member, round(least(0.9, avg(confidence) + 0.1), 6) confidence from pairs group by 1, 2 having count(*) >= 3"))
    def run(spark, d):
        return B.generalised(V.pair_beliefs(spark, d), *keys, other=other)


_general("sp", ("subject", "predicate"), "object")
_general("po", ("predicate", "object"), "subject")


@query("candidate_confidence", with_views("pairs", "select belief_id, round(least(0.95, confidence + least(0.2, 0.02 * evidence) + least(0.2, 0.02 * 3)), 6) confidence from pairs"))
def candidate_confidence(spark, d):
    return V.pair_beliefs(spark, d).select("belief_id", r6(B.candidate_confidence(F.col("confidence"), F.col("evidence"), F.lit(3))).alias("confidence"))


# -- graph --------------------------------------------------------------------------------------


def _seed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query("graph_bfs", with_views("edges", ", recursive_walk(node, depth) as (select 'order:1', 0 union select dst, depth + 1 from recursive_walk join edges on src = node where depth < 3) select 'order:1' as start, node, min(depth) depth from recursive_walk group by node"))
def bfs(spark, d):
    return graph.GraphQuery(V.edges(spark, d)).start("order:1").traverse(depth=3).execute()


PATHS = """, recursive_paths(nodes, last, length, confidence) as (select ['{0}'], '{0}', 0, cast(1 as double) union all select list_append(nodes, dst), dst, length + 1, p.confidence * e.confidence from recursive_paths p join edges e on src = last where length < 3 and not list_contains(nodes, dst))"""


@query("graph_paths", with_views("edges", PATHS.format("order:2") + " select array_to_string(nodes, '>') path, length, round(confidence, 6) confidence from recursive_paths where length > 0"))
def paths(spark, d):
    p = graph.GraphQuery(V.edges(spark, d)).start("order:2").traverse(depth=3).with_paths()
    return p.select(F.array_join("nodes", ">").alias("path"), "length", r6(F.col("confidence")).alias("confidence"))


@query("shortest_path", with_views("edges", ", ends as (select r_name from region order by r_name)" + PATHS.format("order:3") + " select array_to_string(nodes, '>') path, length, round(confidence, 6) confidence from recursive_paths where last in (select r_name from ends) order by length, confidence desc, path limit 1"))
def shortest(spark, d):
    ends = V.table(spark, d, "region").select(F.col("r_name").alias("node"))
    return graph.shortest(V.edges(spark, d), _seed(spark, "order:3"), ends, 3).select(F.array_join("nodes", ">").alias("path"), "length", r6(F.col("confidence")).alias("confidence"))


@query("entity_profile", with_views("edges", ", x as (select src node, dst other, confidence, 1 o, edge_type p from edges union all select dst, src, confidence, 0, edge_type from edges), c as (select node, count(*) n from (select node, lower(p) from x where o = 1 group by all having count(distinct lower(other)) > 1) group by node) select node, count(*) mentions, round(avg(confidence), 6) avg_confidence, cast(sum(o) as bigint) out_edges, cast(count(*) - sum(o) as bigint) in_edges, count(distinct other) related, (max({c: confidence, x: other})).x closest, coalesce(any_value(c.n), 0) contradicted from x left join c using (node) where node in (select n_name from nation) group by node"))
def entity_profile(spark, d):
    return graph.profile(V.edges(spark, d), V.table(spark, d, "nation").select(F.col("n_name").alias("node")))


@query("entity_compare", with_views("edges", ", both_ as (select src, dst from edges union all select dst, src from edges), a as (select distinct lower(dst) node from both_ where src = 'customer:1'), b as (select distinct lower(dst) node from both_ where src = 'customer:2') select coalesce(a.node, b.node) node, case when coalesce(a.node, b.node) in ('customer:1', 'customer:2') then 'direct' when a.node is not null and b.node is not null then 'shared' when a.node is not null then 'first' else 'second' end kind from a full join b on a.node = b.node"))
def compare(spark, d):
    return graph.compared(V.edges(spark, d), "customer:1", "customer:2")


@query("common_ancestors", with_views("edges", ", low as (select lower(src) s, lower(dst) t from edges), recursive_a(node, k) as (select lower(n_name), 0 from nation where n_nationkey = 0 union select s, k + 1 from recursive_a join low on t = node where k < 2), recursive_b(node, k) as (select lower(r_name), 0 from region join nation on n_regionkey = r_regionkey where n_nationkey = 0 union select s, k + 1 from recursive_b join low on t = node where k < 2) select node from recursive_a intersect select node from recursive_b"))
def ancestors(spark, d):
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    row = n.filter("n_nationkey = 0").join(r, n.n_regionkey == r.r_regionkey).first()
    return graph.common_ancestors(V.edges(spark, d), [row["n_name"], row["r_name"]], 2)


@query("hub_entities", with_views("edges", ", x as (select src node, dst other from edges union all select dst, src from edges) select node, count(*) degree, count(distinct other) connected from x group by node having degree >= 3 and connected >= 3 order by degree desc, node limit 10"))
def hubs(spark, d):
    return graph.hubs(V.edges(spark, d))


def _rank_sql(home: str, rounds: int) -> str:
    sql = f", e as (select distinct src, dst from edges), nodes as (select src node from e union select dst from e), od as (select src, count(*) o from e group by src), h as (select node, {home} home, o from nodes left join od on src = node), r0 as materialized (select node, home, o, home rk from h)"
    for i in range(rounds):
        sql += f""", f{i} as (select dst node, sum(rk / o) flow from r{i} join e on src = node where o is not null group by dst), l{i} as (select coalesce(sum(rk), 0) lost from r{i} where o is null),
 r{i + 1} as materialized (select h.node, home, o, 0.85 * coalesce(flow, 0) + (0.85 * lost + 0.15) * home rk from h left join f{i} using (node), l{i})"""
    return sql + f" select node, round(rk, 6) rank from r{rounds} order by rank desc, node limit 40"


@query("pagerank_k", with_views("edges", _rank_sql("1.0 / (select count(*) from nodes)", 5)))
def pagerank(spark, d):
    r = graph.pagerank(V.edges(spark, d), rounds=5).select("node", r6(F.col("rank")).alias("rank"))
    return scoring.top(r, "rank", "node", 40)


@query("ppr_k", with_views("edges", _rank_sql("case when node in ('order:1', 'order:2') then 0.5 else 0.0 end", 5)))
def ppr(spark, d):
    seeds = V.table(spark, d, "orders").filter("o_orderkey in (1, 2)").select(V.numbered("order:", F.col("o_orderkey")).alias("node"))
    r = graph.pagerank(V.edges(spark, d), rounds=5, seeds=seeds).select("node", r6(F.col("rank")).alias("rank"))
    return scoring.top(r, "rank", "node", 40)


@query("propagate_hops", with_views("edges", """, x as (select src, dst from edges union select dst, src from edges), recursive_walk(node, depth) as (select 'customer:1', 0 union select dst, depth + 1 from recursive_walk join x on src = node where depth < 2), near as (select node, min(depth) hop from recursive_walk group by node),
 b as (select subject node, avg(confidence) c from triples group by subject) select node, hop, round(c, 6) previous, round(c + (0.95 - c) * pow(0.5, hop), 6) "new" from near join b using (node)"""))  # fmt: skip
def propagate(spark, d):
    b = V.triples(spark, d).groupBy(F.col("subject").alias("node")).agg(F.avg("confidence").alias("confidence"))
    p = graph.propagated(V.edges(spark, d), _seed(spark, "customer:1"), b, 0.95, depth=2)
    return p.select("node", "hop", r6(F.col("previous")).alias("previous"), r6(F.col("new")).alias("new"))


def _label_sql(rounds: int) -> str:
    sql = ", near as (select src, dst from edges union select dst, src from edges), g0 as (select distinct src node, src label from near)"
    for i in range(rounds):
        sql += f""", v{i} as (select node, label, count(*) n from (select src node, label from near join g{i} on dst = g{i}.node union all select node, label from g{i}) group by all),
 g{i + 1} as materialized (select node, label from (select *, row_number() over (partition by node order by n desc, label) rn from v{i}) where rn = 1)"""
    return sql + f" select label community, count(*) members from g{rounds} group by label"


@query("communities", with_views("edges", _label_sql(3)))
def communities(spark, d):
    return graph.communities(V.edges(spark, d), 3).groupBy("community").agg(F.count(F.lit(1)).alias("members"))


@query("cooccurrence_edges", "with m as (select distinct l_orderkey k, l_suppkey s from lineitem) select 'supplier:' || a.s a, 'supplier:' || b.s b, count(*) weight from m a join m b on a.k = b.k and ('supplier:' || a.s) < ('supplier:' || b.s) group by 1, 2")
def cooccurrence(spark, d):
    return V.suppliers_named(graph.cooccurrences(V.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey"))


@query("cooccurrence_topk", "with m as (select distinct l_orderkey k, 'supplier:' || l_suppkey s from lineitem), w as (select a.s a, b.s b, count(*) weight from m a join m b on a.k = b.k and a.s < b.s group by 1, 2), x as (select *, max(weight) over () t from w) select case when a = 'supplier:1' then b else a end other, round(weight / t, 6) strength from x where (a = 'supplier:1' or b = 'supplier:1') and weight / t >= 0.1 order by strength desc, other limit 20")
def cooccurrence_top(spark, d):
    w = V.suppliers_named(graph.cooccurrences(V.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey"))
    return graph.related(w, "supplier:1")


# -- reflection ---------------------------------------------------------------------------------


@query("session_groups_gap", """with g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) <= 1800000000 then 0 else 1 end n from events),
 s as (select *, sum(n) over (partition by user_id order by ts) session from g) select user_id, count(*) members, epoch_us(min(ts)) start_us, epoch_us(max(ts)) end_us from s group by user_id, session having count(*) >= 2""")  # fmt: skip
def gap_sessions(spark, d):
    s = R.gap_sessions(V.table(spark, d, "events").select("user_id", "ts"), "user_id", "ts")
    return s.select("user_id", "members", V.micros(F.col("start")).alias("start_us"), V.micros(F.col("end")).alias("end_us"))


@query("session_groups", with_views("experiences", "select session_id, count(*) members, count(*) filter (outcome = 'success') successes, count(distinct content) kinds from experiences group by 1 having count(*) >= 2"))
def session_groups(spark, d):
    return R.session_groups(V.experiences(spark, d))


ENTITIES = """list_distinct(list_concat(regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\\b', 0), regexp_extract_all(text, '"([^"]+)"', 1)))"""


@query("entity_groups", f"with n as (select distinct doc_id, lower(unnest({ENTITIES})) entity from documents) select entity, count(*) items from n group by entity having items >= 2")
def entity_groups(spark, d):
    return R.entity_groups(V.table(spark, d, "documents"), "doc_id", "text")


@query("entity_extract_caps", f"select doc_id, len({ENTITIES}) entities from documents")
def entity_caps(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.size(R.entities_in(F.col("text"))).cast("long").alias("entities"))


@query("common_tags", with_views("experiences", ", e as (select session_id || '|' || strftime(occurred_at, '%Y-%m-%d') g, content from experiences), n as (select g, count(*) n from e group by 1), u as (select g, content, count(*) uses from e group by 1, 2) select g, content, uses from u join n using (g) where uses >= greatest(2, floor(n / 2))"))
def common_tags(spark, d):
    e = V.experiences(spark, d).select(F.concat_ws("|", F.col("session_id").cast("string"), F.date_format("occurred_at", "yyyy-MM-dd")).alias("g"), "content")
    return R.common_tags(e, "g", "content")


@query("group_dedupe_jaccard", "with m as (select distinct l_orderkey g, l_suppkey i from lineitem), n as (select g, count(*) n from m group by g), p as (select a.g a, b.g b, count(*) s from m a join m b on a.i = b.i and a.g < b.g group by 1, 2) select a, b, round(s / (x.n + y.n - s), 6) jaccard from p join n x on x.g = a join n y on y.g = b where s / (x.n + y.n - s) > 0.8")
def group_jaccard(spark, d):
    return R.similar_groups(V.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("group_dedupe_first_wins")
def group_first_wins(spark, d):
    return R.first_of_similar(V.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("importance_decay_set", with_views("pairs", ", m as (select confidence median from pairs order by confidence offset (select count(*) // 2 from pairs) limit 1) select belief_id id, confidence score from pairs, m where confidence < median order by score, id limit 100"))
def fading(spark, d):
    return R.fading(V.pair_beliefs(spark, d).select(F.col("belief_id").alias("id"), F.col("confidence").alias("score")))


@query("importance_top_decile", with_views("pairs", "select belief_id id, confidence score from pairs order by score desc, id limit least(50, greatest((select count(*) // 10 from pairs), 1))"))
def strongest(spark, d):
    return R.strongest(V.pair_beliefs(spark, d).select(F.col("belief_id").alias("id"), F.col("confidence").alias("score")))


@query("temporal_pattern_pairs", "with x as (select event_type first, lead(event_type) over (partition by user_id order by ts, event_id) \"then\" from events) select first, \"then\", count(*) times from x where \"then\" is not null group by all having count(*) >= 2")
def pattern_pairs(spark, d):
    return R.consecutive(V.table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


@query("outcome_generalization", with_views("experiences", ", g as (select session_id, count(*) n, count(*) filter (outcome = 'success') good from experiences where outcome is not null group by 1 having count(*) >= 3) select session_id, n, case when good / n >= 0.7 then 'positive' else 'negative' end tendency, round(greatest(good / n, 1 - good / n), 6) share from g where good / n >= 0.7 or 1 - good / n >= 0.7"))
def outcomes(spark, d):
    return R.outcome_generalisation(V.experiences(spark, d), "session_id")


@query("pattern_strength", with_views("pairs", "select belief_id, round(confidence * (0.5 + 0.5 * least(1.0, evidence / 10)), 6) strength from pairs"))
def pattern_strength(spark, d):
    return V.pair_beliefs(spark, d).select("belief_id", r6(R.strength(F.col("confidence"), F.col("evidence"))).alias("strength"))


# -- text ---------------------------------------------------------------------------------------

@query("news_claims", """with s as (select doc_id, list_slice(list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: length(x) >= 20 and not ends_with(x, '?') and not starts_with(x, '"')), 1, 20) c from documents)
 select doc_id, cast(generate_subscripts(c, 1) - 1 as int) claim_no, unnest(c) claim from s""")  # fmt: skip
def news_claims(spark, d):
    return T.claims(V.table(spark, d, "documents"), "text", "doc_id")


@query("html_strip", "select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) plain from pages")
def html(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.without_tags(F.col("html")).alias("plain"))


@query("thread_text", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) thread_text, count(*) messages, count(distinct role) participants from conversations group by conv_id having count(*) between 2 and 500")
def thread_text(spark, d):
    return T.threads(V.table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("reply_threads", """with recursive m as (select conv_id * 1000 + turn id, case when turn > 0 then conv_id * 1000 + turn - 1 end parent from conversations), t as (select id, id root from m where parent is null or parent not in (select id from m) union all select m.id, t.root from m join t on m.parent = t.id) select root, count(*) messages from t group by root""")
def reply_threads(spark, d):
    m = V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    return T.reply_roots(m, "key", "parent").groupBy("root").agg(F.count(F.lit(1)).alias("messages"))


@query("transcript_blocks", """with recursive e as (select user_id, event_id, epoch_us(ts) us from events), starts(user_id, f, block) as (select user_id, min(us), 0 from e group by user_id
 union all select s.user_id, (select min(us) from e where e.user_id = s.user_id and us > s.f + 300000000), s.block + 1 from starts s where exists (select 1 from e where e.user_id = s.user_id and us > s.f + 300000000))
 select e.user_id, e.event_id, cast(s.block as bigint) block from e asof join starts s on e.user_id = s.user_id and e.us >= s.f""")
def transcript_blocks(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", V.micros(F.col("ts")).alias("us"))
    return T.anchored(e, "user_id", "us", "event_id", 300_000_000)


# -- governance ---------------------------------------------------------------------------------


@query("import_outcomes", "with c as (select o_orderkey k from orders where o_orderkey % 3 <> 0), i as (select case when o_orderkey % 11 = 0 then null else o_orderkey end k from orders) select case when i.k is null then 'failed' when c.k is not null then 'skipped' else 'imported' end outcome, count(*) n from i left join c on i.k = c.k group by all")
def import_outcomes(spark, d):
    o = V.table(spark, d, "orders")
    incoming = o.select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")).alias("k"))
    return G.imported(o.filter("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("k")), incoming, "k")[1]


@query("export_filtered", with_views("experiences", "select tenant_id, experience_id, content, epoch_us(occurred_at) created_us from experiences where owner_id = '3' and content in ('purchase', 'signup')"))
def export(spark, d):
    e = V.experiences(spark, d)
    return G.own(e, access.Principal("3", "t3")).filter(e.content.isin("purchase", "signup")).select("tenant_id", "experience_id", "content", V.micros(e.occurred_at).alias("created_us"))


@query("inspect_rollup", with_views("beliefs", ", b as (select *, epoch_us(observed_at) u from beliefs) select 'status' dimension, status item, count(*) n, min(u) first_us, max(u) last_us from b group by status union all select 'privacy_level', privacy_level, count(*), min(u), max(u) from b group by privacy_level union all select 'all', 'all', count(*), min(u), max(u) from b"))
def inspect(spark, d):
    b = V.beliefs(spark, d)
    return G.inspected(b.withColumn("created_us", V.micros(b.observed_at)), "status", "privacy_level")


@query("top_tags", with_views("beliefs", "select tag, count(*) n from (select unnest(shared_with) tag from beliefs) group by tag order by n desc, tag limit 20"))
def top_tags(spark, d):
    return G.top_tags(V.beliefs(spark, d), "shared_with")


@query("audit_statistics", with_views("audit", ", a as (select * from audit where ts >= timestamp '2024-01-20') select action, '*' severity, count(*) n, count(*) filter (not success) failures, count(distinct user_id) users from a group by action union all select '*', severity, count(*), count(*) filter (not success), count(distinct user_id) from a group by severity union all select '*', '*', count(*), count(*) filter (not success), count(distinct user_id) from a"))
def audit_statistics(spark, d):
    return G.audit_statistics(V.audit(spark, d), temporal.at("2024-01-20 00:00:00"))


@query("audit_filter", with_views("audit", "select id, action, severity, user_id from audit where tenant_id = 't3' and severity in ('warning', 'error') order by ts desc, id desc limit 100"))
def audit_filter(spark, d):
    return G.audit_filter(V.audit(spark, d), WHO, least="warning").select("id", "action", "severity", "user_id")


@query("access_summary", with_views("audit", "select user_id, count(*) accesses, epoch_us(max(ts)) last_us from audit group by user_id"))
def access_summary(spark, d):
    a = V.audit(spark, d)
    return G.access_summary(a.withColumn("us", V.micros(a.ts)), "user_id", "us")


@query("upsert_latest", "with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) select user_id, event_type, event_id from r where rn = 1 and not (event_id % 5 = 0)")
def upsert(spark, d):
    e = V.table(spark, d, "events").withColumn("deleted", F.col("event_id") % 5 == 0).withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return G.upserted(e, "key", "ts", "event_id").select("user_id", "event_type", "event_id")


@query("correct_memory", with_views("beliefs", "select status, count(*) n, round(sum(confidence), 4) total from (select case when line = 1 and owner_id = 'u3' then 'validated' else status end status, case when line = 1 and owner_id = 'u3' then 0.99 else confidence end confidence from beliefs) group by status"))
def correct(spark, d):
    b = V.beliefs(spark, d)
    patches = b.filter("line = 1").select("belief_id", F.lit("validated").alias("status"), F.lit(0.99).alias("confidence")).dropDuplicates(["belief_id"])
    out = G.corrected(b, patches, "belief_id", ["status", "confidence"], WHO)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query("provenance_chain", with_views("beliefs", ", t as (select subject, epoch_us(observed_at) a from beliefs) select subject, count(*) events, min(a) first_us from t group by subject"))
def provenance(spark, d):
    b = V.beliefs(spark, d)
    events = b.select("subject", V.micros(b.observed_at).alias("at"), F.lit("observed").alias("event"), F.col("source_id").alias("by"))
    items = b.groupBy("subject").agg(F.min(V.micros(b.observed_at)).alias("created_us"), F.min("owner_id").alias("owner_id"))
    return G.provenance(items, events, "subject").select("subject", "events", F.col("chain")[0]["at"].alias("first_us"))


# -- smaller pieces -----------------------------------------------------------------------------


@query("entropy_regularised_search", with_views("pairs", f", t as (select *, {NATS} h from pairs order by confidence desc, belief_id limit 100) select belief_id, round(confidence - 0.4 * h, 6) score from t order by score desc, belief_id limit 20"))
def entropy_search(spark, d):
    t = scoring.top(V.pair_beliefs(spark, d), "confidence", "belief_id", 100)
    s = F.col("confidence") - 0.4 * scoring.entropy(F.col("confidence"))
    return scoring.top(t.select("belief_id", r6(s).alias("score")), "score", "belief_id", 20)


@query("edge_search", f"select e.vec_id edge_id, round({COS}, 6) score from embeddings e, embeddings q where q.vec_id = 1 and e.vec_id % 3 <> 0 order by score desc, edge_id limit 10")
def edge_search(spark, d):
    e = V.table(spark, d, "embeddings").withColumn("description", F.when(F.col("vec_id") % 3 != 0, F.col("label").cast("string")))
    q = F.broadcast(e.filter("vec_id = 1").select(F.col("embedding").alias("q")))  # one row
    found = e.filter("description is not null").crossJoin(q)
    return scoring.top(found.select(F.col("vec_id").alias("edge_id"), r6(scoring.cosine(F.col("embedding"), F.col("q"))).alias("score")), "score", "edge_id", 10)


@query("procedure_text", "select p_partkey, p_name || chr(10) || p_type || chr(10) || 'Trigger: ' || p_brand || chr(10) || 'Step 1: pick' || chr(10) || 'Step 2: pack' body from part")
def procedure_text(spark, d):
    steps = F.transform(F.array(F.lit("pick"), F.lit("pack")), lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s))
    body = F.concat_ws("\n", F.array("p_name", "p_type", F.concat(F.lit("Trigger: "), "p_brand")), steps)
    return V.table(spark, d, "part").select("p_partkey", body.alias("body"))


@query("decision_payload", "select o_orderkey, cast(json_object('id', o_orderkey, 'title', o_orderpriority, 'status', o_orderstatus) as varchar) payload from orders")
def decision_payload(spark, d):
    o = V.table(spark, d, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"))).alias("payload"))


@query("tumbling_windows", "select epoch_us(time_bucket(interval 1 hour, ts)) start_us, event_type, count(*) n from events group by all")
def tumbling(spark, d):
    w = V.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(V.micros(F.col("w.start").cast("timestamp_ntz")).alias("start_us"), "event_type", "n")


@query("belief_citations", with_views("pairs", "select belief_id, '(' || subject || ', ' || predicate || ', ' || object || ') [' || cast(cast(round(confidence * 100) as bigint) as varchar) || '%]' citation from pairs"))
def citations(spark, d):
    p = V.pair_beliefs(spark, d)
    percent = F.round(F.col("confidence") * 100).cast("long").cast("string")
    return p.select("belief_id", F.concat(F.format_string("(%s, %s, %s) [", "subject", "predicate", "object"), percent, F.lit("%]")).alias("citation"))


@query("merged_patterns", with_views("beliefs", "select status type, subject, predicate, object, max(confidence) confidence, count(*) occurrences, array_to_string(list_slice(list_sort(list(distinct belief_id)), 1, 10), ',') evidence from beliefs group by all"))
def merged(spark, d):
    b = V.beliefs(spark, d).select(F.col("status").alias("type"), "subject", "predicate", "object", "confidence", F.lit(1).cast("long").alias("occurrences"), F.array("belief_id").alias("evidence"))
    return R.merged_patterns(b).withColumn("evidence", F.array_join("evidence", ","))


@query("causal_edges", "with x as (select event_id child, lag(event_id) over (partition by user_id order by ts, event_id) parent from events) select parent, child from x where parent is not null")
def causal_edges(spark, d):
    e = V.table(spark, d, "events")
    parent = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(parent.alias("parent"), F.col("event_id").alias("child")).filter("parent is not null")
