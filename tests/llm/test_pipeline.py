"""The pipeline, stage by stage, against brute-force versions on each stage's own input."""

import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline
from lorebase.llm.queries import tokenizer
from lorebase.storage import materialise
from tests.conftest import SF
from tests.llm.test_operators import WORD, plain_spans, similar, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages, given = docs.columns, [], docs.collect()
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        stages.append(docs.collect())
        if len(stages) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    clean, unique, private, mixed, encoded = stages

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean}
    for r in given:
        w = words(r.text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        if failed or r.doc_id in labels:
            assert (r.doc_id in kept) == (not failed and labels.get(r.doc_id) == 1)

    assert sorted(r.doc_id for r in unique) == sorted(set(similar({r.doc_id: r.text for r in clean}).values()))

    texts = {r.doc_id: r.text for r in unique}
    for r in private:
        spans = plain_spans(texts[r.doc_id])
        assert all(texts[r.doc_id][a:b] not in r.text or k == "ip" for k, a, b in spans if b - a > 8)
        assert r.text == texts[r.doc_id] if not spans and not re.search("[0-9A-Za-z_]{32}|[A-Z]{2}[0-9]{2}|[0-9]{3}-[0-9]{2}", texts[r.doc_id]) else True

    times, size = Counter(r.doc_id for r in mixed), {r.doc_id: len(WORD.findall(r.text)) for r in private}
    assert set(times) <= set(size) and max(times.values()) <= 2
    total = sum(times[i] * n for i, n in size.items())
    assert abs(total - 1.5 * sum(size.values())) <= 20 * 50

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    by_doc = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in mixed}
    assert Counter(r.doc_id for r in encoded) == times
    for r in encoded:
        ids = struct.pack(f"<{len(by_doc[r.doc_id])}I", *by_doc[r.doc_id])
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(by_doc[r.doc_id]), ids, hashlib.sha256(ids).hexdigest())


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-run")
    once = corpus_pipeline.run(spark, SF)
    assert once.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] == docs.columns
    assert Counter(map(tuple, once.collect())) == Counter(map(tuple, docs.collect()))


def test_hostile_rows_pass_all_stages(spark, docs, nothing, tmp_path):
    """Nulls, repeated ids and rows, ties, a very long text, columns with the operators' own names; and no rows at all."""
    text = lambda i: " ".join(f"stone{(i * 31 + j) % 977} river" for j in range(60))
    rows = [(i, text(i), "en", "a" if i % 2 else None, 1) for i in range(12)]
    rows += [(3, text(40), "en", "b", 1), (3, text(3), "en", "a", 1), (None, text(50), None, None, None), (None, text(50), None, None, None), (None, text(51), "de", "b", 2), (20, None, None, None, None), (21, "", "en", "a", 0)]
    rows += [(30, " ".join(f"w{j:x}" for j in range(150_000)), "en", "b", 5), (31, text(1) + " more", "en", "c", 1)]
    hostile = spark.createDataFrame([(*r, "x", 1, "k", "n") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, _row int, _own_key string, node string").repartition(3)
    before, columns = hostile, hostile.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = materialise(stage(spark, before, SF), "test-hostile")
        assert before.columns == columns, name
        if name == "simhash near-dedup":
            got = Counter((r.doc_id, r.text[:40]) for r in before.collect())
            want = [(i, text(i)) for i in range(12)] + [(3, text(40)), (None, text(50)), (None, text(51)), (30, rows[19][1])]
            assert got == Counter((i, t[:40]) for i, t in want)
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count() > 12
    hostile.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
