"""Named queries over indexes, streams, versions and what is learned from tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorebase.catalogue import query
from lorebase.catalogue_text import MAILS
from lorebase.functions import access
from lorebase.operators import learning, reading
from lorebase.plans import views as V
from lorebase.sources import mail
from lorebase.sources.exports import SCHEMA as MESSAGES
from lorebase.sources.exports import Exports
from lorebase.storage import new_folder
from lorebase.streaming import jobs, late
from lorebase.streaming.ledger import Ledger
from lorebase.versions import VersionedTable

# -- vectors ------------------------------------------------------------------------------------

_KNN = """with e as (select vec_id, cast(embedding as double[]) v from embeddings), s as (select q.vec_id query_id, e.vec_id id, round(list_inner_product(q.v, e.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(e.v, e.v)), 6) + 0.0 score from e q, e where q.vec_id % 20 = 0),
 r as (select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from s) select * from r where rank <= 10"""


@query("vector_index_knn", _KNN)
def vector_index_knn(spark, d):
    """The ten nearest of a twentieth of all vectors, by the index, exact."""
    from lorebase.operators import vectors

    e = V.table(spark, d, "embeddings")
    index = vectors.build(e, "vec_id", "embedding")
    return vectors.search(index, e.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", exact=True)


# -- streams ------------------------------------------------------------------------------------

PARTS, DELAY_DAYS, LIFE_DAYS = 4, 2, 20
#: Clicks by when they arrived, 30 days to a part, those of an unknown time last, one in 50 a part late; part and time of what is seen before.
CLICKS = f"""c as (select *, least({PARTS - 1}, coalesce(least({PARTS - 1}, greatest(0, (epoch_us(arrived_at) // 86400000000 - 19723) // 30)), {PARTS - 1}) + case when click_id % 50 = 7 then 1 else 0 end) part from clicks),
 m as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) - interval {DELAY_DAYS} day mark from c group by part)"""


def _clicks(spark, d):
    day = F.unix_date(F.col("arrived_at").cast("date"))
    part = F.coalesce(F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), F.floor((day - 19723) / 30))), F.lit(PARTS - 1))
    return V.table(spark, d, "clicks").withColumn("part", F.least(F.lit(PARTS - 1), part + F.when(F.col("click_id") % 50 == 7, 1).otherwise(0)).cast("int"))


def _in_parts(spark, rows, start):
    """Feed rows (with their part) part by part to a stream that is started anew for each, on one checkpoint."""
    fed, schema = new_folder(spark, "fed"), rows.drop("part").schema
    stream = spark.readStream.schema(schema).parquet(fed)
    for part in range(PARTS):
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(fed)
        start(stream).awaitTermination()


@query("stream_latest_values", f"""with {CLICKS}, known as (select c.* from c join m using (part) where ts is not null and client_id is not null and kind is not null and (mark is null or ts > mark)),
 l as (select client_id, kind, max(epoch_us(ts)) at_us, arg_max(cast(click_id as varchar), (epoch_us(ts), cast(click_id as varchar))) as value from known group by all)
 select cast(client_id as varchar) client_id, kind, value, at_us, at_us // 1000 + {LIFE_DAYS * 86400000} > (select max(epoch_us(ts)) // 1000 - {DELAY_DAYS * 86400000} from c) live from l""")
def stream_latest_values(spark, d):
    """Each client's last click of a kind by event time, over a stream that is started anew between its parts, and whether its life is over."""
    own, at = jobs.stateful(spark), new_folder(spark, "latest")
    rows = _clicks(own, d).select("part", F.col("client_id").alias("owner_id"), F.col("kind").alias("key"), F.col("click_id").alias("value"), F.col("ts").cast("timestamp").alias("at"), F.lit(LIFE_DAYS * 86400000).cast("bigint").alias("ttl_ms"))

    def start(stream):
        known = stream.filter("owner_id is not null and key is not null")
        return jobs.working_memory(known, f"{DELAY_DAYS} days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()

    _in_parts(own, rows, start)
    out = spark.read.schema(jobs.LIVE).parquet(f"{at}/out")
    best = F.max(F.when(F.col("live"), F.struct("at_us", "value")))
    last = out.groupBy("owner_id", "key").agg(best.alias("b"), F.max(F.when(~F.col("live"), F.col("at_us"))).alias("over"))
    return last.select(F.col("owner_id").alias("client_id"), F.col("key").alias("kind"), "b.value", "b.at_us", (~F.coalesce(F.col("over") == F.col("b.at_us"), F.lit(False))).alias("live"))


def _windows(spark, d):
    ledger = Ledger(spark, new_folder(spark, "windows"), "clicks")
    step = late.parted(ledger, "ts", "1 hour", f"{DELAY_DAYS} days", F.col("value"), ["click_id", "ts"])
    start = lambda stream: stream.writeStream.foreachBatch(ledger.run(step)).option("checkpointLocation", f"{ledger.folder}/checkpoint").trigger(availableNow=True).start()
    _in_parts(spark, _clicks(spark, d), start)
    return ledger


_LATE = f"{CLICKS}, w as (select c.*, epoch_us(ts) // 3600000000 h, mark, coalesce((epoch_us(ts) // 3600000000 + 1) * 3600000000 <= epoch_us(mark), false) late from c join m using (part) where ts is not null)"


@query("stream_late_windows", f"with {_LATE} select h * 3600000000 start_us, count(*) n, round(sum(value), 4) + 0.0 total, (h + 1) * 3600000000 <= (select epoch_us(max(ts) - interval {DELAY_DAYS} day) from c) closed from w where not late group by h")
def stream_late_windows(spark, d):
    """Hourly counts of the clicks that came in time, over a stream that is started anew between its parts."""
    w = late.counts(_windows(spark, d), f"{DELAY_DAYS} days")
    return w.select(V.micros(F.col("start")).alias("start_us"), "n", (F.round("total", 4) + F.lit(0.0)).alias("total"), "closed")


@query("stream_late_rows", f"with {_LATE} select click_id, epoch_us(ts) ts_us, epoch_us(mark) mark_us from w where late")
def stream_late_rows(spark, d):
    """The clicks that came too late, with the watermark that they missed."""
    rows = _windows(spark, d).table("late", "click_id bigint, ts timestamp_ntz, watermark timestamp_ntz")
    return rows.select("click_id", V.micros(F.col("ts")).alias("ts_us"), V.micros(F.col("watermark")).alias("mark_us"))


@query("stream_join_sales", "select click_id, sale_id from clicks c join sales s on c.client_id = s.client_id and sold_at >= ts and sold_at <= ts + interval 10 minute")
def stream_join_sales(spark, d):
    """Sales within ten minutes of a click of the same client, two streams joined within a time bound, started anew between parts."""
    ledger, sides = Ledger(spark, new_folder(spark, "joined"), "sales"), []
    for table, columns, when in (("clicks", ["click_id", "client_id"], "ts"), ("sales", ["sale_id", "client_id"], "sold_at")):
        rows, fed = V.table(spark, d, table).select(*columns, F.col(when).cast("timestamp").alias("at"), F.unix_date(F.col(when).cast("date")).alias("day")), new_folder(spark, "fed")
        sides.append((rows, fed, spark.readStream.schema(rows.schema).parquet(fed)))
    clicks, sales = (s[2].drop("day") for s in sides)
    step = late.meeting(ledger, "client_id", "at", "10 minutes", "1 day")
    for first in (True, False):
        for rows, fed, _ in sides:
            rows.filter((F.col("day") < 19783) if first else (F.col("day") >= 19783)).write.mode("append").parquet(fed)
        late.both(clicks, sales).writeStream.foreachBatch(ledger.run(step)).option("checkpointLocation", f"{ledger.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger.table("met", "click_id bigint, r_sale_id bigint").select("click_id", F.col("r_sale_id").alias("sale_id"))


# -- versions -----------------------------------------------------------------------------------

#: Days at which a snapshot of all sales that are known by then is taken.
TAKEN = [19753, 19783, 19813]
SNAPSHOT = "sale_id bigint, client_id bigint, status string, day int"


def _versioned(spark, d):
    """A version for each of four stretches of sales by their day, then one without the sales that are held."""
    t = VersionedTable(spark, new_folder(spark, "versions"), SNAPSHOT)
    sales = V.table(spark, d, "sales").select("sale_id", "client_id", "status", F.unix_date(F.col("sold_at").cast("date")).alias("day")).filter("day is not null")
    for low, high in zip([0, *TAKEN], [*TAKEN, 1 << 30], strict=True):
        t.append(sales.filter((F.col("day") >= low) & (F.col("day") < high)), high, until=str(high))
    t.delete(F.col("status") == "held", 1 << 31)
    return t


_SOLD = "s as (select sale_id, client_id, status, epoch_us(sold_at) // 86400000000 as day from sales where sold_at is not null)"


@query("version_time_travel", f"with {_SOLD}, v as (select * from (values (0, {TAKEN[0]}), (1, {TAKEN[1]}), (2, {TAKEN[2]}), (3, {1 << 30})) v(version, until)) select version, coalesce(status, '-') status, count(*) n, count(distinct client_id) clients from v join s on day < until group by all union all select 4, coalesce(status, '-'), count(*), count(distinct client_id) from s where status is distinct from 'held' group by all")
def version_time_travel(spark, d):
    """What each version of a table held, read by version and by moment."""
    t, out = _versioned(spark, d), None
    for version, moment in enumerate([*TAKEN, 1 << 30, None]):
        at = t.read(version) if moment is None else t.read(moment_us=moment)
        one = at.groupBy(F.coalesce("status", F.lit("-")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("client_id").alias("clients")).withColumn("version", F.lit(version))
        out = one if out is None else out.unionByName(one)
    return out


@query("version_changes", f"with {_SOLD} select sale_id, 'removed' change from s where status = 'held' and day < {TAKEN[1]} union all select sale_id, 'added' from s where day >= {TAKEN[1]} and status is distinct from 'held'")
def version_changes(spark, d):
    """Sales that came or went between the second version and the last."""
    return _versioned(spark, d).changes(1).select("sale_id", "change")


# -- what is learned ----------------------------------------------------------------------------

#: Posteriors of a user's hits, or misses, alone: Beta(1 + n, 1) and Beta(1, 1 + n), whose quantiles have a closed form.
NEAR = 0.03


@query("sampled_posteriors", """with n as (select user_id, event_type = 'purchase' hit, count(*) n from events group by all), p as (select distinct case when hit then 1.0 + n else 1.0 end a, case when hit then 1.0 else 1.0 + n end b from n)
 select a, b, round(a / (a + b), 6) mean, round(case when b = 1 then pow(0.025, 1 / a) else 1 - pow(0.975, 1 / b) end, 6) low, round(case when b = 1 then pow(0.975, 1 / a) else 1 - pow(0.025, 1 / b) end, 6) high from p""")  # fmt: skip
def sampled_posteriors(spark, d):
    """Means and 95 % intervals by Monte Carlo; a sampled value is given as its closed form if it lies within NEAR of it, else as it is."""
    n = V.table(spark, d, "events").groupBy("user_id", (F.col("event_type") == "purchase").alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    more = (F.col("n") + 1).cast("double")
    p = learning.sampled_posteriors(n.select(F.when(F.col("hit"), more).otherwise(1.0).alias("a"), F.when(F.col("hit"), 1.0).otherwise(more).alias("b")), "a", "b")
    a, b, one = F.col("a"), F.col("b"), F.col("b") == 1
    exact = {"mean": a / (a + b), "low": F.when(one, F.pow(F.lit(0.025), 1 / a)).otherwise(1 - F.pow(F.lit(0.975), 1 / b)), "high": F.when(one, F.pow(F.lit(0.975), 1 / a)).otherwise(1 - F.pow(F.lit(0.025), 1 / b))}
    return p.select("a", "b", *[F.round(F.when(F.abs(F.col(c) - x) <= NEAR, x).otherwise(F.col(c)), 6).alias(c) for c, x in exact.items()])


_NB_WORDS = "(select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> ''))) word from documents)"


@query("quality_classifier", f"""with w as (select * from {_NB_WORDS}), l as (select d.doc_id, quality from documents d join labels using (doc_id)), t as (select * from l where doc_id % 2 = 0), s as (select sum(quality) ones, sum(1 - quality) zeros from t),
 c as (select word, sum(quality) in1, sum(1 - quality) in0 from w join t using (doc_id) group by word), p as (select word, (in1 + 1) / (ones + 2) p1, (in0 + 1) / (zeros + 2) p0 from c, s),
 g as (select word, ln(p1 / p0) - ln((1 - p1) / (1 - p0)) weight, ln((1 - p1) / (1 - p0)) absent from p), b as (select coalesce(sum(absent), 0) + ln((any_value(ones) + 1) / (any_value(zeros) + 1)) prior from g, s),
 o as (select l.doc_id, quality, coalesce(sum(weight), 0) + any_value(prior) odds from l cross join b left join w on w.doc_id = l.doc_id left join g on g.word = w.word where l.doc_id % 2 = 1 group by 1, 2)
 select quality, cast(odds > 0 as int) said, count(*) n from o group by all""")  # fmt: skip
def quality_classifier(spark, d):
    """Labels of odd documents by words learned from even ones, against the truth."""
    docs, labels = V.table(spark, d, "documents"), V.table(spark, d, "labels").select("doc_id", "quality")
    known = docs.select("doc_id", "text").join(labels, "doc_id")
    weights, prior = learning.word_weights(known.filter("doc_id % 2 = 0"), "doc_id", "text", "quality")
    said = learning.classified_texts(known.filter("doc_id % 2 = 1"), "doc_id", "text", weights, prior)
    return said.withColumnRenamed("label", "said").join(known.select(F.col("doc_id").alias("id"), "quality"), "id").groupBy("quality", "said").agg(F.count(F.lit(1)).alias("n"))


#: Tokens of texts with what they are known to be: the labels that rules are learned from.
KNOWN = {"mail": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$", "ip": r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$", "phone": r"^\+[0-9][0-9().-]{7,}$"}
_LABEL = "case " + " ".join(f"when regexp_matches(token, '{p}') then '{k}'" for k, p in KNOWN.items()) + " end"


def _shape_sql(level: int) -> str:
    out, plus = "token", "+" if level else ""
    for i, of in enumerate(learning.CLASSES[level]):
        out = f"regexp_replace({out}, '{of}', chr({0xE000 + i}), 'g')"
    out = f"regexp_replace({out}, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g')"
    for i, of in enumerate(learning.CLASSES[level]):
        out = f"regexp_replace({out}, chr({0xE000 + i}) || '{plus}', '{of}{plus}', 'g')"
    return out


_TOKENS = f"""x as (select doc_id % 2 part, unnest(string_split_regex(text, '[ \\t\\r\\n]+')) token from documents where text is not null), t as (select part, token, {_LABEL} label, count(*) n from x where token <> '' group by all),
 v as (select part, token, label, n, unnest([{', '.join(f"struct_pack(level := {i}, pattern := {_shape_sql(i)})" for i in range(learning.LEVELS))}], recursive := true) from t),
 s as (select level, pattern, label, sum(n) support from v where part = 0 group by all), e as (select level, pattern, sum(support) every from s group by all),
 g as (select level, pattern, label, support, support / every as ratio from s join e using (level, pattern) where label is not null and support >= 5 and support / every >= 0.9),
 k as (select distinct level, pattern, label from (select token, v.label, max_by(struct_pack(level := v.level, pattern := v.pattern), (v.level, v.pattern)) w from v join g using (level, pattern, label) where part = 0 group by 1, 2) q, lateral (select w.level as level, w.pattern as pattern) z),
 r as (select g.* from g join k using (level, pattern, label))"""


def _spans(spark, d):
    tokens = V.table(spark, d, "documents").filter("text is not null").select((F.col("doc_id") % 2).alias("part"), F.explode(F.split("text", "[ \t\r\n]+")).alias("token")).filter("token <> ''")
    label = F.lit(None).cast("string")
    for kind, pattern in reversed(KNOWN.items()):
        label = F.when(F.col("token").rlike(pattern), kind).otherwise(label)
    return tokens.withColumn("label", label)


@query("learned_rules", f"with {_TOKENS} select pattern, label entity_type, level, support, round(ratio, 6) as precision from r")
def learned_rules(spark, d):
    """Rules for entities that are learned from the tokens of even documents."""
    rules = learning.learned_rules(_spans(spark, d).filter("part = 0"), "token", "label")
    return rules.withColumn("precision", F.round("precision", 6))


@query("learned_rule_quality", f"""with {_TOKENS}, o as (select token, v.label truth, n, r.label said, row_number() over (partition by token, v.label order by ratio desc, support desc, r.label) k from v join r using (level, pattern) where part = 1),
 f as (select said entity_type, sum(n) found, sum(case when truth = said then n else 0 end) as good from o where k = 1 group by 1), p as (select label entity_type, sum(n) present from t where part = 1 and label is not null group by 1)
 select entity_type, coalesce(found, 0) found, coalesce(good, 0) as "right", coalesce(present, 0) present, round(good / found, 6) as precision, round(case when present is null then null else coalesce(good, 0) / present end, 6) as recall from p full join f using (entity_type)""")  # fmt: skip
def learned_rule_quality(spark, d):
    """What those rules find in the other documents: precision and recall."""
    spans = _spans(spark, d)
    rules = learning.learned_rules(spans.filter("part = 0"), "token", "label")
    q = learning.rule_quality(spans.filter("part = 1"), "token", "label", rules)
    return q.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


# -- reading and answers ------------------------------------------------------------------------


@query("packed_readings", """with recursive r as (select row_number() over (order by source nulls first, doc_id nulls first, t) place, * from (select source, doc_id, left(text, 24000) t from documents) where trim(t) <> ''), x as (select place, source, (place - 1) // 5000 s, length(t) n, t from r),
 b as (select *, source is not distinct from lag(source) over (order by place) and s is not distinct from lag(s) over (order by place) same from x),
 w as (select place, source, t, n, n used, place as first from b where place = 1
  union all select b.place, b.source, b.t, b.n, case when b.same and w.used + 7 + b.n <= 24000 then w.used + 7 + b.n else b.n end, case when b.same and w.used + 7 + b.n <= 24000 then w.first else b.place end from w join b on b.place = w.place + 1)
 select source, first, count(*) texts, max(used) chars, md5(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place)) digest from w group by source, first""")  # fmt: skip
def packed_readings(spark, d):
    """Documents packed by source into chunks for a language model, with each chunk's digest."""
    p = reading.packed(V.table(spark, d, "documents"), "source", ["doc_id"], "text")
    return p.select("source", "first", "texts", "chars", F.md5("chunk").alias("digest"))


#: What a model might say of an order line: by its key a fenced object, a bare array, prose around an object, broken or no JSON.
ANSWERS = """a as (select l_orderkey * 8 + l_linenumber id, l_orderkey % 6 kind, 'part ' || l_partkey p, 'Supplier ' || l_suppkey s, case when l_linenumber % 4 = 0 then '"high"' else cast(l_linenumber / 4 as varchar) end c from lineitem)"""


def _answers(spark, d):
    li, kind = V.table(spark, d, "lineitem"), F.col("l_orderkey") % 6
    part, supplier = V.numbered("part ", F.col("l_partkey")), V.numbered("Supplier ", F.col("l_suppkey"))
    conf = F.when(F.col("l_linenumber") % 4 == 0, '"high"').otherwise((F.col("l_linenumber") / 4).cast("string"))
    q = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    fact = q('{"subject": "', part, '", "predicate": "sold by", "object": "', supplier, '", "confidence": ', conf, "}")
    said = (
        F.when(kind == 0, q('```json\n{"facts": [', fact, '], "events": [{"actor": "', supplier, '", "action": "shipped", "target": "', part, '"}]}\n```'))
        .when(kind == 1, q("[", fact, ', {"subject": "', part, '"}]')).when(kind == 2, q('Sure: {"relationships": [{"entity_a": "', part, '", "relation": "from", "entity_b": "', supplier, '", "confidence": ', conf, "}]} Done."))
        .when(kind == 3, q('{"arguments": [{"claim": "', part, '", "stance": "for", "topic": "', supplier, '"}], "facts": "none"}')).when(kind == 4, q('{"facts": [', fact)).otherwise(q("Nothing about ", part))
    )
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), said.alias("answer"))


_CONF = "greatest(0.1, least(0.95, coalesce(try_cast(c as double), 0.7)))"


@query("extracted_patterns", f"""with {ANSWERS}, p as (select id, 'facts' kind, p subject, 'sold by' predicate, s object, {_CONF} confidence from a where kind in (0, 1) union all select id, 'events', s, 'shipped', p, 0.7 from a where kind = 0
  union all select id, 'relationships', p, 'from', s, {_CONF} from a where kind = 2 union all select id, 'arguments', p, 'for', s, 0.7 from a where kind = 3)
 select kind, lower(subject) subject, predicate, lower(object) as object, max(confidence) confidence, count(*) occurrences, array_to_string(list_sort(list(distinct id))[1:10], ',') evidence from p group by 1, 2, 3, 4""")  # fmt: skip
def extracted_patterns(spark, d):
    """Patterns of a model's answers about all order lines, those that say the same as one."""
    good, _ = reading.extracted(_answers(spark, d), "id", "answer")
    return reading.distinct_patterns(good).withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


@query("rejected_answers", f"with {ANSWERS} select case kind when 1 then 'incomplete' when 4 then 'broken json' else 'no json' end reason, count(*) n, count(distinct id) answers from a where kind in (1, 4, 5) group by 1")
def rejected_answers(spark, d):
    """Why answers, or items of theirs, hold no pattern."""
    _, bad = reading.extracted(_answers(spark, d), "id", "answer")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("answers"))


# -- policies -----------------------------------------------------------------------------------


@query("policy_table_decisions", """with x as (select 0 as version, case when status = 'held' then 'held' when total > 300 then 'large' when status = 'done' then 'done' else 'default' end policy from sales
  union all select 1, case when priority >= 4 then 'urgent' when status = 'held' then 'held' when status = 'done' and total > 300 then 'done' else 'default' end from sales)
 select version, policy, policy in ('urgent', 'large', 'done') allowed, count(*) n from x group by all""")  # fmt: skip
def policy_table_decisions(spark, d):
    """Decisions on sales by a table of policies, before and after rows of it change."""
    t = VersionedTable(spark, new_folder(spark, "policies"), access.POLICIES)
    row = lambda *rows: spark.createDataFrame(list(rows), access.POLICIES)
    t.append(row(("held", 90, "status = 'held'", False, 1, False), ("large", 50, "total > 300", True, 1, False), ("done", 10, "status = 'done'", True, 1, False)), 1)
    t.append(row(("urgent", 100, "priority >= 4", True, 2, False), ("large", 50, "total > 300", True, 2, True), ("done", 10, "status = 'done' and total > 300", True, 2, False), ("large-no", 60, "total > 300", False, 2, False), ("large-no", 60, "total > 300", False, 3, True)), 2)
    columns, out = ["status string", "total double", "priority int"], None
    for version in (0, 1):
        said = access.decided(access.policies_of(t.read(version), columns))
        one = V.table(spark, d, "sales").select(F.lit(version).alias("version"), said.alias("s")).groupBy("version", "s.policy", "s.allowed").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# -- a data source ------------------------------------------------------------------------------

_MAILBOX = f"with {MAILS} select id, role || ' <' || role || '@x.org>' sender, t body from m"


def _mailbox(spark, d, where):
    """Mails of the turns of conversations, as mailboxes in a folder."""
    c = V.table(spark, d, "conversations").filter(where).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.trim(F.regexp_replace("text", "\n+", " ")).alias("t"))
    head = F.concat(F.lit("From - \nFrom: "), "role", F.lit(" <"), "role", F.lit("@x.org>\nSubject: turn "), F.col("id").cast("string"), F.lit("\n\n"))
    return c.select(F.concat(head, F.regexp_replace("t", "(?m)^From ", ">From "), F.lit("\n")).alias("value"))


def _mail_rows(raw):
    m = mail.emails(raw, "raw", "file", "start")
    return m.select(F.regexp_extract("subject", "turn ([0-9]+)", 1).cast("bigint").alias("id"), "sender", F.regexp_replace("body", "(?m)^>From ", "From ").alias("body"))


@query("source_mailboxes", _MAILBOX)
def source_mailboxes(spark, d):
    """Mails by the data source, its files read in ranges of 16 KB."""
    spark.dataSource.register(Exports)
    path = new_folder(spark, "mailboxes")
    _mailbox(spark, d, F.lit(True)).write.mode("append").text(path)
    return _mail_rows(spark.read.format("lorebase_exports").option("path", path).option("split", 1 << 14).load())


@query("source_mailboxes_stream", _MAILBOX)
def source_mailboxes_stream(spark, d):
    """The same as a stream, started anew after more files have come."""
    spark.dataSource.register(Exports)
    path, at = new_folder(spark, "mailboxes"), new_folder(spark, "mailboxes-read")
    for part in range(2):
        _mailbox(spark, d, F.col("conv_id") % 2 == part).write.mode("append").text(path)
        stream = spark.readStream.format("lorebase_exports").option("path", path).option("split", 1 << 14).load()
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _mail_rows(spark.read.schema(MESSAGES).parquet(f"{at}/out"))
