"""SQL of the queries that SQL can express, written independently of the operators' plans."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
#: Words of a text, lower-cased from A to Z.
_LOWERED = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"


def op2(iterations: int = 25, prior: float = 0.85, clean: float = 0.97, junk: float = 0.5, accuracy: float = 0.85) -> str:
    """Signals, votes, expectation-maximisation unrolled over the vote patterns, and the verdict."""

    def vote(bad: str, good: str) -> str:
        return f"case when {bad} then -1 when {good} then 1 else 0 end"

    votes = [
        vote("n_symbols * 20 > word_chars", "n_symbols * 200 <= word_chars"), vote("n_capitals * 10 > word_chars * 4", "n_capitals * 10 <= word_chars"),
        vote("n_marks * 2 > n_words", "n_marks * 10 <= n_words"), vote("n_repeat_words * 10 > n_words * 4", "n_repeat_words * 5 <= n_words"),
        vote("n_dup_lines * 2 > n_lines", "n_dup_lines * 10 <= n_lines"), vote("word_chars > n_words * 14 or word_chars < n_words * 2", "word_chars <= n_words * 9"),
    ]
    j = range(len(votes))
    chars = lambda c: f"len(regexp_extract_all(coalesce(text, ''), '[{c}]'))"
    logit = "ln(prior / (1 - prior)) + " + " + ".join(f"case v{i} when 1 then ln(c{i} / b{i}) when -1 then ln((1 - c{i}) / (1 - b{i})) else 0 end" for i in j)
    sql = f"""with d as (select row_number() over () r, doc_id, {_WORDS} ws, text from documents),
 grams as (select r, unnest(range(1, len(ws) - 1)) i, ws from d), keyed as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] k from grams),
 twice as (select r, i from (select r, i, count(*) over (partition by r, k) n from keyed) where n > 1),
 rep as (select r, count(distinct i + o) n from twice, (select unnest(range(0, 3)) o) group by r),
 lines as (select r, unnest(string_split(coalesce(text, ''), chr(10))) line from d), ln as (select r, count(*) n, count(distinct line) u from lines where regexp_matches(line, '{WORD}') group by r),
 f as (select doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, {chars('#*$%&|<>')} n_symbols, {chars('!?')} n_marks, {chars('A-Z')} n_capitals, coalesce(ln.n, 0) n_lines, coalesce(ln.n - ln.u, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
  from d left join ln using (r) left join rep using (r)),
 g as (select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 base_failed, {', '.join(f'{v} v{i}' for i, v in enumerate(votes))} from f),
 p as (select {', '.join(f'v{i}' for i in j)}, count(*) n from g where not base_failed group by all),
 s0 as (select cast({prior} as double) prior, {', '.join(f'cast({clean} as double) c{i}, cast({junk} as double) b{i}' for i in j)})"""
    for k in range(iterations):
        sums = ", ".join(f"sum(case when v{i} <> 0 then q * n else 0 end) g{i}, sum(case when v{i} > 0 then q * n else 0 end) gu{i}, sum(case when v{i} <> 0 then (1 - q) * n else 0 end) h{i}, sum(case when v{i} > 0 then (1 - q) * n else 0 end) hu{i}" for i in j)
        sql += f""",
 e{k} as (select p.*, 1 / (1 + exp(-({logit}))) q from p, s{k}), m{k} as (select sum(n) total, sum(q * n) good, {sums} from e{k}),
 n{k} as (select (good + {prior}) / (total + 1) prior, {', '.join(f'(gu{i} + {clean}) / (g{i} + 1) c{i}, (hu{i} + {junk}) / (h{i} + 1) b{i}' for i in j)} from m{k}),
 s{k + 1} as materialized (select prior, {', '.join(f'greatest(c{i}, 1 - (1 - b{i}) * (1 - prior) / prior * {1 - accuracy} / {accuracy}) c{i}, b{i}' for i in j)} from n{k})"""
    return sql + f""" select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 1 / (1 + exp(-({logit}))) >= 0.5 kept from g, s{iterations}"""


OP6 = f"""with d as (select doc_id, {_WORDS} ws from documents),
 w as (select doc_id, ws, unnest(range(1, len(ws) - 18)) s from d),
 later as (select doc_id, s from (select doc_id, s, row_number() over (partition by array_to_string(ws[s : s + 19], ' ') order by doc_id, s) n from w) where n > 1),
 gone as (select distinct doc_id, s + o i from later, (select unnest(range(0, 20)) o)),
 each as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) i from d),
 kept as (select e.doc_id, count(g.i) n_removed, sha256(coalesce(string_agg(word, ' ' order by e.i) filter (g.i is null), '')) kept_sha256 from each e left join gone g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id)
 select d.doc_id, len(ws) n_words, coalesce(n_removed, 0) n_removed, coalesce(kept_sha256, sha256('')) kept_sha256 from d left join kept using (doc_id)"""

#: Bytes as pairs of hex digits; runs of removed bytes are windows that begin at most 100 bytes apart.
OP7 = """with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
 w as (select r, doc_id, s, md5(substr(h, 2 * s + 1, 200)) k from (select r, doc_id, h, unnest(range(0, length(h) // 2 - 99)) s from d)),
 later as (select r, s from (select r, s, row_number() over (partition by k order by doc_id, s) n from w) where n > 1),
 marked as (select r, s, case when s <= lag(s) over (partition by r order by s) + 100 then 0 else 1 end begins from later),
 runs as (select r, min(s) a, max(s) + 100 b from (select r, s, sum(begins) over (partition by r order by s) run from marked) group by r, run),
 gaps as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) before from runs),
 kept as (select r, cast(sum(b - a) as bigint) n_removed, count(*) n_spans, max(b) last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) front from gaps join d using (r) group by r)
 select doc_id, length(h) // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256 from d left join kept using (r)"""

OP8 = f"""with w as (select doc_id, unnest({_LOWERED}) term from documents),
 dl as (select doc_id, count(*) dl from w group by doc_id),
 stats as (select (select count(*) from documents) n, (select sum(dl) from dl) / (select count(*) from documents) avgdl),
 tf as (select doc_id, term, count(*) tf from w group by all), df as (select term, count(*) df from tf group by term),
 scored as (select q.doc_id query_id, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * q.tf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score
  from tf q join tf d using (term) join df using (term) join dl on dl.doc_id = d.doc_id, stats where q.doc_id % 20 = 0 group by 1, 2),
 ranked as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) rank from scored)
 select query_id, rank, doc_id, score from ranked where rank <= 10"""


#: Components by walking from node to node; every pair that shares a shingle is compared.
OP11 = f"""with recursive d as (select row_number() over () r, doc_id, {_LOWERED} ws from documents),
 s as (select r, doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end g from d),
 n as (select g, min(r) node, min(doc_id) least from (select r, doc_id, list_sort(g) g from s) where len(g) > 0 group by g), t as (select node, len(g) n, unnest(g) k from n),
 e as (select a.node a, b.node b from t a join t b on a.k = b.k and a.node <> b.node group by a.node, b.node having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
 walk as (select node, node other from n union select walk.node, e.b from walk join e on walk.other = e.a),
 c as (select walk.node, min(least) component_id from walk join n on n.node = walk.other group by walk.node)
 select doc_id, len(s.g) n_shingles, case when len(s.g) = 0 then doc_id else component_id end component_id from s left join n on n.g = list_sort(s.g) and len(s.g) > 0 left join c on c.node = n.node"""


def crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit: a step takes in a byte (0 or more) or shifts by one bit (-1)."""
    steps = f"list_prepend(4294967295, flatten(list_transform(string_split({text}, ''), lambda c: [cast(ord(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda a, s: case when s >= 0 then xor(a, s) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295)"


def op13() -> str:
    """Trees level by level, siblings by place, and the fold of each row's siblings."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    beside = lambda tree, leaves, same: f"""select l.r, u.lv, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos < l.pos // pow3), '') a, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos > l.pos // pow3), '') b
  from {leaves} l join (select *, cast(pow(3, lv) as bigint) pow3 from {tree}) u on {same} and u.c > 1 and u.pos // 3 = l.pos // pow3 // 3 group by 1, 2"""  # noqa: E731
    grow = lambda tree, start, by: f"""{tree} as (select {by} g, 0 as lv, pos, h, count(*) over (partition by {by}) c from {start}
  union all select g, lv, pos, h, count(*) over (partition by g) from (select g, lv + 1 as lv, pos // 3 as pos, sha256(string_agg(h, '' order by pos)) h from {tree} where c > 1 group by g, lv, pos // 3))"""  # noqa: E731
    return f"""with recursive d as (select *, {leaf('text')} h, case when {crc32('cast(doc_id as varchar)')} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf('text')} end t from documents),
 l as materialized (select row_number() over () r, row_number() over (partition by source order by doc_id, h) - 1 as pos, * from d),
 {grow('up', 'l', 'source')},
 s as (select row_number() over (order by encode(g) nulls first) - 1 as pos, row_number() over () r, g, h from (select g, arg_max(h, lv) h from up group by g)),
 {grow('top', 's', '0')},
 near as (select l.r, 0 part, x.lv, x.a, x.b from l join ({beside('up', 'l', 'u.g is not distinct from l.source')}) x using (r)
  union all select l.r, 1, x.lv, x.a, x.b from l join s on s.g is not distinct from l.source join ({beside('top', 's', 'true')}) x on x.r = s.r),
 path as (select r, string_agg(a || b, '' order by part, lv) p, list(a || '|' || b order by part, lv) steps from near group by r),
 folded as (select doc_id, l.h leaf, s.h subroot, (select arg_max(h, lv) from top) root, sha256(coalesce(p, '')) proof_sha256,
   list_reduce(list_prepend(t, coalesce(steps, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) folded_root
  from l join s on s.g is not distinct from l.source left join path on path.r = l.r)
 select *, folded_root = root verified from folded"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": op2(), "op6_substring_dedup": OP6, "op7_suffix_array_dedup": OP7, "op8_bm25_top_k": OP8, "op11_ngram_jaccard": OP11, "op13_merkle_manifest": op13()}
