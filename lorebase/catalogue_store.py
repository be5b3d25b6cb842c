"""Named queries over the store: reading by id, scans, decisions, governance, windows, clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorebase.catalogue import DECAY, EVENTS_AT, HALF, NATS, NOW_US, ORDERS_AT, SEES, WHO, _procedures, acl, query, r6
from lorebase.functions import access, scoring, temporal
from lorebase.memory import Memory
from lorebase.operators import beliefs as B
from lorebase.operators import governance as G
from lorebase.operators import graph, learning
from lorebase.operators import reflection as R
from lorebase.operators import retrieval as S
from lorebase.operators import text as T
from lorebase.plans import views as V
from lorebase.plans.views import with_views
from lorebase.storage import materialise, shared_dir

# -- points, scans, writes ----------------------------------------------------------------------


def _store(spark):
    return Memory(spark, f"{shared_dir(spark)}/lorebase/store-{uuid.uuid4().hex}", access.Principal("u3", "t3"), access.Preferences(blocked_topics=["supplier:7"]))


@query("store_beliefs", with_views("pairs", "select belief_id, subject, object, case when evidence > 2 then 0.99 else confidence end confidence from pairs where not contains(object, 'supplier:7') and evidence <> 2"))
def store_beliefs(spark, d):
    """Commit, correct and forget in a store of its own; the blocked topic stays out."""
    m, p = _store(spark), V.pair_beliefs(spark, d)
    m.commit(p.select("belief_id", "subject", "predicate", "object", "confidence"), 1)
    m.commit(p.filter("evidence > 2").select("belief_id", "subject", "predicate", "object", F.lit(0.99).alias("confidence")), 2)
    twice = p.filter("evidence = 2").select("belief_id").distinct()
    gone = m.beliefs().join(twice, "belief_id", "left_semi").withColumn("deleted", F.lit(True))
    m.append("beliefs", gone, 3)
    return m.beliefs().select("belief_id", "subject", "object", "confidence")


@query("store_edges", with_views("experiences", ", p as (select *, lag(experience_id) over (partition by session_id order by occurred_at, experience_id) parent from experiences) select edge_type, count(*) n, cast(sum(cast(src as bigint)) as bigint) sources from (select cast(parent as varchar) src, 'caused' edge_type from p where parent is not null union all select cast(order_id as varchar), 'assumes' from (select l_orderkey order_id from lineitem)) group by edge_type"))
def store_edges(spark, d):
    """Experiences with their cause and decisions with what they assume leave edges."""
    m, e = _store(spark), V.experiences(spark, d)
    parent = F.lag("experience_id").over(Window.partitionBy("session_id").orderBy("occurred_at", "experience_id"))
    m.record(e.select(F.col("experience_id").cast("string").alias("experience_id"), "content", "occurred_at", parent.cast("string").alias("causal_parent")), 1)
    a = V.assumptions(spark, d)
    held = F.array(F.struct("belief_id", F.lit("").alias("description"), F.col("confidence_then").alias("confidence_at_decision"), F.col("critical").alias("is_critical")))
    m.decide(a.select(F.col("decision_id").cast("string").alias("decision_id"), held.alias("assumptions")), 2)
    return m.all("edges").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src").cast("long")).alias("sources"))


@query("belief_lookup", with_views("beliefs", f"select belief_id, status, confidence from beliefs where order_id in (1, 5, 9) and {SEES}"))
def belief_lookup(spark, d):
    b = V.beliefs(spark, d)
    return b.filter(b.order_id.isin(1, 5, 9) & acl(b)).select("belief_id", "status", "confidence")


@query("triple_scan", with_views("pairs", "select belief_id, confidence from pairs where subject = 'part:7' and confidence >= 0.3 union all select * from (select belief_id, confidence from pairs where object = 'supplier:3' and confidence >= 0.9 order by confidence desc, belief_id limit 25)"))
def triple_scan(spark, d):
    p = V.pair_beliefs(spark, d)
    return B.scan(p, subject="part:7", least=0.3).unionByName(B.scan(p, object_="supplier:3", least=0.9, k=25)).select("belief_id", "confidence")


@query("beliefs_by_entity_capped", with_views("beliefs", ", r as (select belief_id, row_number() over (order by belief_id) place from beliefs where object = 'supplier:3') select belief_id, place + 100 place from r where place <= 100"))
def by_entity_capped(spark, d):
    return B.by_entity(V.beliefs(spark, d), "supplier:3", each=100).select("belief_id", "place")


@query("neighbours", with_views("edges", "select distinct case when src = 'customer:1' then dst else src end node, edge_type from edges where src = 'customer:1' or dst = 'customer:1' order by node, edge_type limit 15"))
def neighbours(spark, d):
    near = graph.both_ways(V.edges(spark, d).select("src", "dst", "edge_type")).filter("src = 'customer:1'")
    return near.select(F.col("dst").alias("node"), "edge_type").distinct().orderBy("node", "edge_type").limit(15)


@query("entity_types", "select case e when 0 then 'belief' when 1 then 'experience' when 2 then 'note' when 3 then 'procedure' when 4 then 'working' else 'unknown' end kind, count(*) n from (select event_id % 6 e from events) group by 1")
def entity_types(spark, d):
    e = V.table(spark, d, "events").select((F.col("event_id") % 6).cast("int").alias("e"), F.col("event_id").cast("string").alias("k"))
    stem = F.get(F.array(*[F.lit(x) for x in ("t1/u1/belief-", "experience-", "belief-", "x/procedure-", "working-", "mybelief")]), F.col("e"))
    kind = G.entity_type(F.concat(stem, "k"), F.when(F.col("e") == 2, "note").otherwise(""))
    return e.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("export_created", with_views("beliefs", "select belief_id, epoch_us(coalesce(valid_until, valid_from, observed_at)) created_us from beliefs where owner_id = 'u3'"))
def export_created(spark, d):
    b = G.own(V.beliefs(spark, d), WHO)
    return b.select("belief_id", V.micros(F.coalesce("valid_until", "valid_from", "observed_at")).alias("created_us"))


# -- retrieval ----------------------------------------------------------------------------------

FOUND = "w as (select doc_id, list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> '') ws from {table}), dl as (select doc_id, len(ws) dl, ws from w), corpus as (select count(*) n, avg(dl) a from dl), tf as (select doc_id, dl, term, count(*) tf from (select doc_id, dl, unnest(ws) term from dl) where term in ({terms}) group by all), df as (select term, count(*) df from tf group by term), bm as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) score from tf join df using (term), corpus group by doc_id)"


@query("filtered_search", f"with en as (select * from documents where lang = 'en'), {FOUND.format(text='text', table='en', terms=chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'rest' + chr(39))} select doc_id, round(score, 6) score from bm order by score desc, doc_id limit 15")
def filtered_search(spark, d):
    en = V.table(spark, d, "documents").filter("lang = 'en'")
    return scoring.top(scoring.bm25(en, scoring.query_terms("The rest?"), "doc_id", "text").withColumn("score", r6(F.col("score"))), "score", "doc_id", 15)


@query("query_experiences", f"with x as (select event_id doc_id, event_type || ' ' || props t from events), {FOUND.format(text='t', table='x', terms=chr(39) + 'purchase' + chr(39) + ', ' + chr(39) + '42' + chr(39))} select doc_id experience_id, round(score, 6) score from bm order by score desc, doc_id limit 20")
def query_experiences(spark, d):
    e = V.table(spark, d, "events").withColumn("t", F.concat_ws(" ", "event_type", "props"))
    return scoring.top(scoring.bm25(e, ["purchase", "42"], "event_id", "t").select(F.col("event_id").alias("experience_id"), r6(F.col("score")).alias("score")), "score", "experience_id", 20)


@query("recall_decisions", f"with x as (select o_orderkey doc_id, o_orderpriority || ' ' || c_mktsegment t from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'P'), {FOUND.format(text='t', table='x', terms=chr(39) + 'urgent' + chr(39) + ', ' + chr(39) + 'furniture' + chr(39))} select doc_id decision_id, round(score, 6) score from bm order by score desc, doc_id limit 10")
def recall_decisions(spark, d):
    o = V.table(spark, d, "orders").filter("o_orderstatus <> 'P'").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = scoring.bm25(o.withColumn("t", F.concat_ws(" ", "o_orderpriority", "c_mktsegment")), ["urgent", "furniture"], "o_orderkey", "t")
    return scoring.top(found.select(F.col("o_orderkey").alias("decision_id"), r6(F.col("score")).alias("score")), "score", "decision_id", 10)


@query("back_filled_beliefs", with_views("triples", ", f as (select belief_id, confidence score from triples where predicate = 'part_of' order by belief_id limit 5), r as (select belief_id, score, false back_filled from f union all select belief_id, confidence, true from triples where (lower(object) in (select lower(n_name) from nation where n_nationkey < 2) or lower(subject) in (select lower(n_name) from nation where n_nationkey < 2)) and belief_id not in (select belief_id from f)) select * from r order by back_filled, score desc, belief_id limit 30"))
def back_filled(spark, d):
    t = V.triples(spark, d)
    found = t.filter("predicate = 'part_of'").orderBy("belief_id").limit(5).select("belief_id", F.col("confidence").alias("score"))
    names = [r.n_name for r in V.table(spark, d, "nation").filter("n_nationkey < 2").select("n_name").collect()]  # two nations
    return S.back_filled(found, t, names, 30)


@query("entropy_of_beliefs", with_views("pairs", f"select belief_id, round({NATS}, 6) entropy from pairs where confidence >= 0.2 order by confidence desc, belief_id limit 40"))
def entropy_of_beliefs(spark, d):
    p = scoring.top(V.pair_beliefs(spark, d).filter("confidence >= 0.2"), "confidence", "belief_id", 40)
    return p.select("belief_id", r6(scoring.entropy(F.col("confidence"))).alias("entropy"))


@query("context_text", with_views("pairs experiences", f""", m as ((select 'belief' k, belief_id id, round(confidence, 6) score, '(' || subject || ', ' || predicate || ', ' || object || ')' content from pairs order by score desc, id limit 5)
 union all (select 'experience', cast(experience_id as varchar), round(greatest(0.0, 1 - ({NOW_US} - epoch_us(occurred_at)) / 3.6e9 / 168), 6) score, content || coalesce(' → ' || outcome, '') from experiences order by score desc, 2 limit 3))
 select 'Relevant memories:' || chr(10) || string_agg('- [' || k || '] ' || content || ' (' || printf('%.2f', score) || ')', chr(10) order by k, score desc, id) said from m"""))  # fmt: skip
def context_text(spark, d):
    b = S.remembered_beliefs(V.pair_beliefs(spark, d).withColumn("score", F.col("confidence"))).unionByName(S.remembered_experiences(V.experiences(spark, d), EVENTS_AT))
    best = S.limited(b.withColumn("score", r6(F.col("score"))), {"belief": 5, "experience": 3})
    return spark.createDataFrame([(S.context_text(best.collect()),)], "said string")  # eight rows


@query("procedure_recall", with_views("", "procedures as (select l_partkey k, any_value(p_name) nm, count(*) filter (l_returnflag = 'N') good, count(*) filter (l_returnflag = 'R') bad, any_value(lower(p_type) || ' → ' || lower(p_brand)) st from lineitem join part on p_partkey = l_partkey group by 1) select 'part:' || k id, round(0.8 * case when good + bad = 0 then 0.5 else good / (good + bad) end, 6) score, nm || ': ' || st content from procedures"))
def procedure_recall(spark, d):
    return S.remembered_procedures(_procedures(spark, d)).select("id", r6(F.col("score")).alias("score"), "content")


#: A rule for each name of a part: an extractor whose pattern is the name and whose type is that of the first part with it.
_RULES = "x as (select 'r:' || p_name rule_id, p_name pattern, min_by(p_type, p_partkey) entity_type, 'part of ' || min_by(p_brand, p_partkey) description from part group by p_name)"


def _rules(spark, d):
    """A store with these rules, without those of economy parts, and one that can't be used."""
    m = _store(spark)
    first = lambda c: F.min_by(c, "p_partkey")
    parts = V.table(spark, d, "part").groupBy("p_name").agg(first("p_type").alias("kind"), F.concat(F.lit("part of "), first("p_brand")).alias("said"))
    saved = [T.Extractor(f"r:{r.p_name}", r.kind, r.p_name, description=r.said) for r in parts.collect()]  # names of parts are few, whatever their number
    assert m.save_rules([*saved, T.Detector("broken", "(")], 1) == len(saved)
    for r in saved:
        if r.entity_type == "ECONOMY":
            m.delete_rule(r.id, 2)
    return m


@query("similar_rules", f"with {_RULES}, k as (select rule_id doc_id, description || ' ' || pattern || ' ' || entity_type t from x where entity_type <> 'ECONOMY'), " + FOUND.format(text="t", table="k", terms="'widget', 'large'") + " select doc_id rule_id, round(score, 6) score from bm order by score desc, doc_id limit 10")
def similar_rules(spark, d):
    return _rules(spark, d).similar_rules("large Widget", 10).select("rule_id", r6(F.col("score")).alias("score"))


@query("rule_store", f"with {_RULES} select rule_id, 'extractor' kind, entity_type, pattern, description from x where entity_type <> 'ECONOMY'")
def rule_store(spark, d):
    """Rules that are saved, deleted and read again."""
    return _rules(spark, d).all("rules").select("rule_id", "kind", "entity_type", "pattern", "description")


# -- judgement ----------------------------------------------------------------------------------


@query("conflicts_in_results", with_views("pairs", ", t as (select * from pairs order by confidence desc, belief_id limit 60) select a.belief_id a_id, b.belief_id b_id, a.subject from t a join t b on a.subject = b.subject and a.belief_id < b.belief_id and a.object <> b.object"))
def conflicts(spark, d):
    return B.conflicts(scoring.top(V.pair_beliefs(spark, d), "confidence", "belief_id", 60))


@query("contradiction_scores", with_views("pairs", ", x as (select subject, list_sort(list(confidence)) c from pairs group by 1 having count(*) > 1) select subject, round(greatest(0.0, c[-1] + c[-2] - 1), 6) score from x where c[-1] + c[-2] - 1 >= 0.5"))
def contradiction_scores(spark, d):
    """The two surest statements about a subject: what their probabilities exceed 1 by, from 0.5 on."""
    w = Window.partitionBy("subject").orderBy(F.col("confidence").desc(), "belief_id")
    two = V.pair_beliefs(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 2").groupBy("subject").pivot("n", [1, 2]).agg(F.max("confidence"))
    return two.select("subject", r6(B.contradiction_score(F.col("1"), F.col("2"))).alias("score")).filter("score >= 0.5")


AGE = f"(epoch_us(timestamp '{ORDERS_AT}') - epoch_us(observed_at)) / 1e6"


@query("full_proof", with_views("beliefs", f""", t as (select *, case when not ((valid_from is null or valid_from <= timestamp '{ORDERS_AT}') and (valid_until is null or timestamp '{ORDERS_AT}' <= valid_until)) then 'out_of_bounds' when ttl_seconds is not null and {AGE} > ttl_seconds then 'expired' when {AGE} > 30 * 86400 then 'stale' else 'valid' end reason from beliefs order by confidence desc, belief_id limit 50),
 g as (select count(*) c from (select subject from t group by subject having count(distinct object) > 1))
 select count(*) beliefs, any_value(c) contradictions, count(*) filter (reason in ('valid', 'stale')) valid, round(avg(case when reason in ('out_of_bounds', 'expired') then 0.0 else confidence * {DECAY} end), 6) mean_left, count(*) filter (status = 'validated') evidence_for, count(*) filter (status <> 'validated') evidence_against, string_agg(belief_id || '=' || reason, ',' order by belief_id) validity from t, g"""))  # fmt: skip
def full_proof(spark, d):
    p = B.full_proof(scoring.top(V.beliefs(spark, d), "confidence", "belief_id", 50), ORDERS_AT, half_life_days=HALF)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("validity")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return p.select("beliefs", "contradictions", "valid", r6(F.col("mean_left")).alias("mean_left"), "evidence_for", "evidence_against", listed.alias("validity"))


@query("evidence_ratios", with_views("pairs", "select evidence, count(*) n, round(evidence / (evidence + 1), 6) ratio from pairs group by evidence"))
def evidence_ratios(spark, d):
    p = V.pair_beliefs(spark, d)
    ratio = S.evidence_ratio(F.array_repeat(F.lit("e"), F.col("evidence").cast("int")), F.array(F.lit("no")))
    return p.groupBy("evidence", r6(ratio).alias("ratio")).agg(F.count(F.lit(1)).alias("n"))


@query("beta_interval", with_views("pairs", ", g as (select evidence, avg(confidence) c, count(*) n from pairs group by evidence) select evidence, n, round((2 * c + evidence) / (3 + evidence), 4) mean, round(sqrt((2 * c + evidence) * (2 * (1 - c) + 1) / (4 + evidence)) / (3 + evidence), 4) deviation from g"))
def beta_interval(spark, d):
    """Posteriors by Monte Carlo: mean and deviation in their closed form where what is sampled lies within 2 % and 5 % of it, else as sampled."""
    p = V.pair_beliefs(spark, d).groupBy("evidence").agg(F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("n"))
    x = materialise(p.withColumns({"a": 2 * F.col("c") + F.col("evidence"), "b": 2 * (1 - F.col("c")) + 1}), "posteriors")  # a mean that is summed anew may differ in its last bit and not meet itself
    s = learning.sampled_posteriors(x, "a", "b")
    mean, deviation = F.col("a") / (F.col("a") + F.col("b")), F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    near = lambda exact, found, by: F.round(F.when(F.abs(found / exact - 1) <= by, exact).otherwise(found), 4)
    return x.join(s, ["a", "b"]).select("evidence", "n", near(mean, F.col("mean"), 0.02).alias("mean"), near(deviation, F.col("deviation"), 0.05).alias("deviation"))


@query("candidate_beliefs", with_views("beliefs", ", m as (select status, subject, predicate, object, max(confidence) c, count(*) o, least(10, count(distinct belief_id)) e from beliefs group by all) select status type, subject, predicate, object, round(least(0.95, c + least(0.2, 0.02 * e) + least(0.2, 0.02 * o)), 6) confidence from m where round(least(0.95, c + least(0.2, 0.02 * e) + least(0.2, 0.02 * o)), 6) >= 0.5 order by confidence desc, type, subject, predicate, object limit 50"))
def candidate_beliefs(spark, d):
    b = V.beliefs(spark, d).select(F.col("status").alias("type"), "subject", "predicate", "object", "confidence", F.lit(1).cast("long").alias("occurrences"), F.array("belief_id").alias("evidence"))
    return R.candidates(R.merged_patterns(b))


@query("entity_average", with_views("beliefs", "select object, count(*) n, round(avg(confidence), 9) avg_confidence, count(distinct source_id) sources from beliefs group by object"))
def entity_average(spark, d):
    return V.beliefs(spark, d).groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 9).alias("avg_confidence"), F.count_distinct("source_id").alias("sources"))


@query("latest_snapshot", "with s as (select user_id, ts, event_id from events where event_type = 'purchase'), t as (select user_id from s group by user_id order by count(*) desc, user_id limit 1) select 'user:' || user_id task_context, epoch_us(ts) taken_us, cast(event_id as varchar) snapshot_id from s join t using (user_id) order by ts desc, snapshot_id limit 10")
def latest_snapshot(spark, d):
    """The latest snapshots of a task, among those stored for all tasks."""
    m, e = _store(spark), V.table(spark, d, "events").filter("event_type = 'purchase'")
    m.snapshot(e.select(F.col("event_id").cast("string").alias("snapshot_id"), V.numbered("user:", F.col("user_id")).alias("task_context"), F.col("ts").alias("taken_at"), F.lit("public").alias("privacy_level")), 1)
    task = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").first()["user_id"]
    return m.snapshots(f"user:{task}", 10).select("task_context", V.micros(F.col("taken_at")).alias("taken_us"), "snapshot_id")


# -- graph --------------------------------------------------------------------------------------


@query("typed_traversal", with_views("edges", ", x as (select src, dst from edges union select dst, src from edges), a as (select dst n from x where src = 'customer:1'), b as (select dst n from x join a on src = n) select distinct node from (select n node from a union select n from b union select 'customer:1') where node in (select n_name from nation) or node like 'customer:%'"))
def typed_traversal(spark, d):
    e = V.edges(spark, d)
    nodes = V.table(spark, d, "nation").select(F.col("n_name").alias("node"), F.lit("nation").alias("node_type")).unionByName(V.table(spark, d, "customer").select(V.numbered("customer:", F.col("c_custkey")).alias("node"), F.lit("customer").alias("node_type")))
    return graph.GraphQuery(e).start("customer:1").traverse(direction="both", depth=2).filter(node_types=("nation", "customer"), nodes=nodes).invoke("traverse").select("node")


@query("all_paths", with_views("edges", ", x as (select src, dst, confidence c from edges union all select dst, src, confidence from edges), one as (select 'customer:1>' || m.dst || '>' || e.dst path, 2 length, m.c * e.c confidence from x m join x e on e.src = m.dst where m.src = 'customer:1' and e.dst = (select n_name from nation where n_nationkey = 99) ) select path, length, round(confidence, 6) confidence from one union all (select 'customer:1>' || a.dst || '>' || b.dst, 2, round(a.c * b.c, 6) from x a join x b on b.src = a.dst where a.src = 'customer:1' and b.dst = (select min(r_name) from region r join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey where c_custkey = 1) and b.dst <> 'customer:1' order by 3 desc, 1 limit 10)"))
def all_paths(spark, d):
    e = graph.both_ways(V.edges(spark, d))
    c = V.table(spark, d, "customer").filter("c_custkey = 1").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    start = spark.createDataFrame([("customer:1",)], "node string")
    return graph.all_paths(e, start, c.first()["r_name"], 2).select(F.array_join("nodes", ">").alias("path"), "length", r6(F.col("confidence")).alias("confidence"))


@query("entity_mentions", with_views("beliefs", "select object node, count(*) mentions, epoch_us(min(observed_at)) first_us, epoch_us(max(observed_at)) last_us from beliefs group by object"))
def entity_mentions(spark, d):
    b = V.beliefs(spark, d).select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("edge_type"), "confidence", "observed_at")
    who = V.table(spark, d, "supplier").select(V.numbered("supplier:", F.col("s_suppkey")).alias("node"))
    return graph.profile(b, who, at="observed_at").select("node", "mentions", V.micros(F.col("first_at")).alias("first_us"), V.micros(F.col("last_at")).alias("last_us"))


@query("community_clusters", "with recursive x as (select 'n' || (n_nationkey % 5) src, 'n' || (n_nationkey % 5) || '.' || n_nationkey dst from nation), m as (select distinct src hub, src node from x union select src, dst from x) select min(node) community, count(*) members, count(*) * (count(*) - 1) // 2 links from m group by hub")
def community_clusters(spark, d):
    """Stars that have no edge between them are the communities of highest modularity."""
    hub = F.concat(F.lit("n"), (F.col("n_nationkey") % 5).cast("string"))
    e = V.table(spark, d, "nation").select(hub.alias("src"), F.concat(hub, F.lit("."), F.col("n_nationkey").cast("string")).alias("dst"))
    found = graph.louvain(e)
    named = found.groupBy("community").agg(F.min("node").alias("name"))
    return graph.clusters(found.join(named, "community").select("node", F.col("name").alias("community")))


# -- governance ---------------------------------------------------------------------------------


def _forget(name, request, chosen_sql, text=None, tags=None):
    @query(f"forget_{name}", with_views("experiences", f"select tenant_id, count(*) n, cast(sum(experience_id) as bigint) ids from experiences where not (owner_id = '7' and ({chosen_sql})) group by 1"))
    def run(spark, d):
        e = V.experiences(spark, d)
        chosen = request.chosen("occurred_at", entity="experience_id", text=F.col("content"), tags=F.array("content", F.lit("Event")))
        assert not request.problems()
        left = G.forget(e, chosen, access.Principal("7", "t3"), "experience_id")
        return left.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("experience_id").alias("ids"))


_forget("entity", G.ForgetRequest("entity", entity_id="42"), "experience_id = 42")
_forget("session", G.ForgetRequest("session", session_id=7), "session_id = 7")
_forget("topic", G.ForgetRequest("topic", topics=("ERROR", "view")), "content in ('error', 'view')")
_forget("time_range", G.ForgetRequest("time_range", before="2024-01-05 00:00:00", after="2024-01-25 00:00:00"), "occurred_at < timestamp '2024-01-05' or occurred_at > timestamp '2024-01-25'")
_forget("query", G.ForgetRequest("query", query="CH"), "contains(content, 'ch')")
_forget("all", G.ForgetRequest("all"), "true")


@query("forget_statuses", "with o as (select *, o_custkey % 3 < 2 mine from orders where o_orderkey % 7 = 0), t as (select o_custkey % 40 s, count(*) filter (mine) done, count(*) filter (not mine) failed from o group by 1) select 's' || s session_id, done, failed, case when failed = 0 then 'completed' when done > 0 then 'partially_completed' else 'failed' end status from t where s < 4")
def forget_statuses(spark, d):
    """What requests to forget sessions reached: rows that their principal may see but doesn't own stay and count as failed."""
    m, o = _store(spark), V.table(spark, d, "orders").filter("o_orderkey % 7 = 0")
    rows = o.select(F.col("o_orderkey").cast("string").alias("belief_id"), V.numbered("s", F.col("o_custkey") % 40).alias("source_id"), *[F.lit("x").alias(c) for c in ("subject", "predicate", "object")], F.lit("public").alias("privacy_level"), (F.col("o_custkey") % 3 < 2).alias("_mine"))
    m.commit(rows.filter("_mine"), 1)
    other = Memory(spark, m.path, access.Principal("u9", "t3"))
    other.commit(rows.filter("not _mine"), 1)
    out = [(f"s{s}", *m.forget_counts(G.ForgetRequest("session", session_id=f"s{s}"), 2 + s)) for s in range(4)]
    return spark.createDataFrame(out, "session_id string, done bigint, failed bigint, status string")


@query("retention_expiry", with_views("beliefs", f"select status, count(*) n from beliefs where valid_until is not null and timestamp '1998-01-01' > valid_until group by status"))
def retention_expiry(spark, d):
    b = V.beliefs(spark, d)
    return b.filter(access.retention_over(b.valid_until, "1998-01-01 00:00:00")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("privacy_changes", with_views("beliefs", "select privacy_level, count(*) n from (select case when line = 2 and owner_id = 'u3' then 'public' else privacy_level end privacy_level from beliefs) group by 1"))
def privacy_changes(spark, d):
    b = V.beliefs(spark, d)
    level = F.when((b.line == 2) & access.may_change(WHO, b.owner_id), "public").otherwise(b.privacy_level)
    return b.groupBy(level.alias("privacy_level")).agg(F.count(F.lit(1)).alias("n"))


@query("audit_window", with_views("audit", "select id, user_id from audit where tenant_id = 't3' and success and action = 'purchase' and ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-20' order by ts desc, id desc limit 40"))
def audit_window(spark, d):
    a = V.audit(spark, d).withColumn("resource", F.col("action"))
    return G.audit_filter(a, WHO, success=True, resource="purchase", since=temporal.at("2024-01-10 00:00:00"), until=temporal.at("2024-01-20 00:00:00"), k=40).select("id", "user_id")


@query("audit_cleanup", with_views("audit", f"select action, count(*) filter (ts < timestamp '{EVENTS_AT}' - interval 10 day) removed, count(*) filter (ts >= timestamp '{EVENTS_AT}' - interval 10 day) kept from audit group by action"))
def audit_cleanup(spark, d):
    a = V.audit(spark, d)
    kept = G.kept_by_retention(a, "ts", temporal.at(EVENTS_AT), 10).groupBy("action").agg(F.count(F.lit(1)).alias("kept"))
    every = a.groupBy("action").agg(F.count(F.lit(1)).alias("n")).join(kept, "action", "left")
    return every.select("action", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("removed"), F.coalesce("kept", F.lit(0)).alias("kept"))


@query("access_log", with_views("audit", "select id, action from audit where user_id = 'u3' order by ts desc, id desc limit 30"))
def access_log(spark, d):
    return G.access_log(V.audit(spark, d), WHO, 30).select("id", "action")


@query("default_severities", "select event_type, case when event_type = 'error' then 'warning' when event_type in ('view', 'search') then 'debug' when event_type = 'purchase' then 'warning' else 'info' end severity, count(*) n from events group by all")
def default_severities(spark, d):
    named = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "export").otherwise(F.col("event_type"))
    e = V.table(spark, d, "events")
    return e.groupBy("event_type", access.default_severity(named, F.col("event_type") != "error").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("access_decisions", with_views("beliefs", f"select case when {SEES} then 'granted' else 'denied' end access, count(*) n from beliefs group by 1"))
def access_decisions(spark, d):
    return G.shown(V.beliefs(spark, d), WHO).groupBy("access").agg(F.count(F.lit(1)).alias("n"))


@query("related_items", with_views("edges", ", s as (select dst k, array_to_string(list_slice(list_sort(list(distinct src)), 1, 5), ',') sources from edges group by 1), t as (select src k, array_to_string(list_slice(list_sort(list(distinct dst)), 1, 5), ',') derived from edges group by 1) select 'customer:' || c_custkey node, coalesce(sources, '') sources, coalesce(derived, '') derived from customer left join s on s.k = 'customer:' || c_custkey left join t on t.k = 'customer:' || c_custkey"))
def related_items(spark, d):
    items = V.table(spark, d, "customer").select(V.numbered("customer:", F.col("c_custkey")).alias("node"))
    r = G.related_items(V.edges(spark, d), items, "node")
    return r.select("node", F.array_join("sources", ",").alias("sources"), F.array_join("derived", ",").alias("derived"))


@query("provenance_events", with_views("beliefs", "select subject, count(*) + 1 events from beliefs group by subject"))
def provenance_events(spark, d):
    b = V.beliefs(spark, d)
    events = b.select("subject", V.micros(b.observed_at).alias("at"), F.lit("observed").alias("event"), F.col("source_id").alias("by"))
    items = b.groupBy("subject").agg(F.min(V.micros(b.observed_at)).alias("created_us"), F.min("owner_id").alias("owner_id"))
    chain = G.provenance(items, events, "subject", most=1_000_000)
    more = G.with_event(F.col("chain"), F.lit(1).cast("long"), "verified", F.lit("u3"))
    return chain.select("subject", F.size(more).cast("long").alias("events"))


@query("session_profiles", with_views("experiences", """, n as (select session_id, count(*) members, min(occurred_at) a, max(occurred_at) b from experiences group by 1 having count(*) >= 2), u as (select session_id, content, count(*) uses from experiences group by 1, 2),
 t as (select session_id, array_to_string(list_sort(list(content)), ',') tags from u join n using (session_id) where uses >= greatest(2, floor(members / 2)) group by 1),
 e as (select session_id, count(*) entities from (select session_id, e from (select session_id, unnest(list_distinct([lower(content), lower(tenant_id)])) e from experiences) group by all having count(*) >= 2) group by 1)
 select session_id, members, epoch_us(a) start_us, epoch_us(b) end_us, coalesce(tags, '') tags, coalesce(entities, 0) entities from n left join t using (session_id) left join e using (session_id)"""))  # fmt: skip
def session_profiles(spark, d):
    p = R.session_profiles(V.experiences(spark, d), "session_id", "occurred_at", "content", F.array("content", "tenant_id"))
    return p.select("session_id", "members", V.micros(F.col("start")).alias("start_us"), V.micros(F.col("end")).alias("end_us"), F.array_join("tags", ",").alias("tags"), "entities")


# -- windows, cubes, defaults -------------------------------------------------------------------


@query("cube_of_orders", "select coalesce(o_orderstatus, '*') status, coalesce(o_orderpriority, '*') priority, count(*) n, count(distinct o_custkey) customers from orders group by cube (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    c = V.table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return c.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "customers")


@query("rollup_of_nations", "select coalesce(r_name, '*') region, coalesce(n_name, '*') nation, count(*) n, round(sum(c_acctbal), 2) balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by rollup (r_name, n_name)")
def rollup(spark, d):
    c = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return g.select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("n_name", F.lit("*")).alias("nation"), "n", "balance")


@query("window_frames", "select event_id, ntile(4) over w quartile, round(percent_rank() over w, 6) place, cast(sum(event_id) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) as bigint) running, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) within_hour, first_value(event_id) over w first_event from events window w as (partition by user_id order by ts, event_id)")
def window_frames(spark, d):
    e = V.table(spark, d, "events").withColumn("us", V.micros(F.col("ts")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        "event_id", F.ntile(4).over(w).cast("long").alias("quartile"), r6(F.percent_rank().over(w)).alias("place"), F.sum("event_id").over(w.rowsBetween(-2, 0)).alias("running"),
        F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)).alias("within_hour"), F.first("event_id").over(w).alias("first_event"),
    )


@query("memory_classification", "select case when event_type in ('purchase', 'view') then 'experience' else 'belief' end memory_type, case when event_type in ('purchase', 'view') then 0.9 else 0.5 end confidence, count(*) n from events group by all")
def memory_classification(spark, d):
    """A classifier that knows some kinds; what it says nothing of is a belief at 0.5."""
    known = F.when(F.col("event_type").isin("purchase", "view"), F.struct(F.lit("experience").alias("kind"), F.lit(0.9).alias("confidence")))
    c = S.classified(known)
    return V.table(spark, d, "events").groupBy(c["kind"].alias("memory_type"), c["confidence"].alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("clamped_confidence", "select doc_id, greatest(0.1, least(0.95, coalesce(try_cast(case when doc_id % 5 = 0 then 'bad' else cast(doc_id % 13 / 10 as varchar) end as double), 0.7))) confidence from documents")
def clamped(spark, d):
    given = F.when(F.col("doc_id") % 5 == 0, "bad").otherwise((F.col("doc_id") % 13 / 10).cast("string"))
    return V.table(spark, d, "documents").select("doc_id", temporal.clamped(given).alias("confidence"))


@query("transcript_minutes", "select event_id, round(date_part('hour', ts) * 60 + date_part('minute', ts) + date_part('second', ts) / 60, 6) as minutes from events")
def transcript_minutes(spark, d):
    """The times of events, written as H:M:S and read back as minutes."""
    e = V.table(spark, d, "events")
    return e.select("event_id", r6(temporal.clock_minutes(F.date_format("ts", "H:mm:ss"))).alias("minutes"))


@query("usable_weights", "select case event_type when 'click' then 'vector' when 'view' then 'text' when 'purchase' then 'temporal' else 'confidence' end signal, round(avg(value) - case when event_type = 'error' then 1000 else 0 end, 4) weight from events where event_type in ('click', 'view', 'purchase', 'error') group by event_type having avg(value) - case when event_type = 'error' then 1000 else 0 end <> 0")
def usable_weights(spark, d):
    """Weights that the events' mean values give to signals: unknown signals and weights of zero are left out."""
    names = {"click": "vector", "view": "text", "purchase": "temporal", "error": "confidence", "signup": "magic"}
    e = V.table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("w"))
    weights = {names[r.event_type]: r.w - (1000 if r.event_type == "error" else 0) for r in e.collect() if r.event_type in names}  # a row for each type
    return spark.createDataFrame(sorted((k, round(w, 4)) for k, w in scoring.usable_weights(weights).items()), "signal string, weight double")


@query("stream_session_windows", """with g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) <= 1800000000 then 0 else 1 end n from events), s as (select *, sum(n) over (partition by user_id order by ts) session from g),
 w as (select user_id, epoch_us(min(ts)) start_us, epoch_us(max(ts)) + 1800000000 end_us, count(*) members from s group by user_id, session) select * from w where end_us <= (select epoch_us(max(ts)) - 3600000000 from events)""")  # fmt: skip
def stream_sessions(spark, d):
    """Sessions of the events as a stream: those that the watermark, an hour behind the last event, has closed."""
    from lorebase.streaming import jobs

    schema = V.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _is_folder(spark, f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = f"{shared_dir(spark)}/lorebase/stream-{uuid.uuid4().hex}"
    s = jobs.drained(jobs.sessions(events, "user_id", "ts"), f"{at}/out", f"{at}/checkpoint")
    us = lambda c: V.micros(F.col(c).cast("timestamp_ntz"))
    return s.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "members")


def _is_folder(spark, path):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@query("meaning_search", "select 1 one, count(*) filter (doc_id is not null) n from documents where doc_id = 0")
def meaning_search(spark, d):
    """The stand-in's embeddings find a text by itself."""
    from lorebase.functions.providers import embedded

    docs = V.table(spark, d, "documents").select("doc_id", embedded(F.col("text"), prefix="passage: ").alias("v"))
    q = F.broadcast(V.table(spark, d, "documents").filter("doc_id = 0").select(embedded(F.col("text"), prefix="passage: ").alias("q")))  # one row
    best = scoring.top(docs.crossJoin(q).select("doc_id", F.round(scoring.dot(F.col("v"), F.col("q")), 6).alias("score")), "score", "doc_id", 1)
    return best.filter("doc_id = 0").agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("n"))
