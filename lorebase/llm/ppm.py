"""Language-model scoring by prediction by partial matching.

The model is a byte-context trie of depth ``DEPTH``, learned from the training documents: for
every context of 0 to DEPTH symbols, how often each symbol follows.  A text's code length is
accumulated symbol by symbol, ended by an end symbol.  The longest known context predicts
first; a symbol it has not seen costs an escape (method C: distinct symbols against
occurrences), after which the next shorter context predicts with the symbols already ruled out
excluded; below the empty context all symbols left are equally likely.

Counting covers all training text and every pair counts, however rare.  Each block of documents
(:mod:`.blocks`) lists its distinct grams (a symbol with its DEPTH predecessors) and how often
training documents hold them; the counts are summed by gram.  Grams with the same ``NEAR``
predecessors hold all longer contexts that any of them can meet, so the trie is built and asked
piece by piece, and only the pairs of orders below NEAR, which the alphabet bounds, are
broadcast.  A block then fetches by key what its own grams cost.

Word counts for the base score are exchanged by block in the same way.

Defined cases: a null or empty text is the end symbol alone; a null id counts as the empty text
for the choice of training documents; without training text every symbol is equally likely;
repeated rows are scored each for itself and all count; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.arrow import slices, text_bytes
from lorebase.llm.blocks import dealt
from lorebase.storage import materialise

DEPTH = 5
#: Predecessors that tell the pieces of the trie apart.
NEAR = 2
#: Grams that a piece of the trie has, about; those with the same NEAR predecessors stay together.
PIECE = 1 << 16
#: Bytes of text in a block: the larger, the fewer blocks list the same gram or word.
BLOCK = 24_000_000
#: Bytes of text of a block that are turned into grams at once.
SLICE = 500_000
#: Pairs that a task counts before it hands them on.
FLUSH = 3_000_000
END, START, BITS, SYMBOLS = 256, 257, 9, 257
_LOWER = np.array([*range(65), *range(97, 123), *range(91, 256)], dtype=np.uint8)
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_logs double, score double"


def held_out(doc_id: Column, one_in: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % one_in == 0


def codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts end to end: each symbol with its DEPTH predecessors as one integer, and where each text's symbols begin."""
    n = len(offsets) - 1
    symbols = np.full(len(raw) + n * (DEPTH + 1), START, dtype=np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    symbols[np.arange(len(raw)) + row * (DEPTH + 1) + DEPTH] = _LOWER[raw]
    ends = offsets[1:] + np.arange(n) * (DEPTH + 1) + DEPTH
    symbols[ends] = END
    out = np.zeros(len(symbols), dtype=np.uint64)
    for back in range(DEPTH + 1):
        out[back:] |= symbols[: len(symbols) - back] << np.uint64(BITS * back)
    return out[symbols != START], offsets[:-1] + np.arange(n)


class Trie:
    """The model: by order, its sorted pairs and contexts with what escaping from them costs."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """pairs: by order, the pairs (context and symbol as one integer, sorted) and their counts."""
        self.pairs, self.contexts = pairs, []
        for order, (keys, counts) in enumerate(pairs):
            contexts, at = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total, distinct = np.bincount(at, weights=counts, minlength=len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)
            rest, others = np.zeros(len(contexts)), np.zeros(len(contexts))
            if order and len(keys):
                below, (lower_keys, lower_counts) = self.contexts[order - 1], pairs[order - 1]
                shared = lower_counts[np.searchsorted(lower_keys, keys & mask(order))]
                parent = np.searchsorted(below[0], contexts & mask(order - 1))
                rest = below[1][parent] - np.bincount(at, weights=shared, minlength=len(contexts))
                others = below[2][parent] - distinct
            #: Context; its total and distinct symbols; and of its parent without the symbols seen here, the same.
            self.contexts.append((contexts, total, distinct, rest, others))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its predecessors."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        child, child_order = np.full(len(grams), -1), -1
        for order in range(DEPTH, -1, -1):
            keys, counts = self.pairs[order]
            contexts, total, distinct, _, _ = self.contexts[order]
            if not len(keys):
                continue
            own = grams[open_] & mask(order + 1)
            context = own >> np.uint64(BITS)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            there = contexts[at] == context
            entered = child >= 0
            n, d = total[at], distinct[at]
            if child_order >= 0:
                _, _, _, rest, others = self.contexts[child_order]
                n, d = np.where(entered, rest[child], n), np.where(entered, others[child], d)
            pair = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = there & (keys[pair] == own)
            out[open_[hit]] += np.log10(counts[pair[hit]] / (n[hit] + d[hit]))
            escape = there & ~hit & (d > 0)
            out[open_[escape]] += np.log10(d[escape] / (n[escape] + d[escape]))
            keep = ~hit
            child, child_order = np.where(there, at, -1)[keep], order
            open_ = open_[keep]
        left = SYMBOLS - (self.contexts[0][2][0] if len(self.pairs[0][0]) else 0)
        out[open_] -= np.log10(max(left, 1))
        return out


def mask(symbols: int) -> np.uint64:
    return np.uint64((1 << BITS * symbols) - 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with their counts together."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct))


def _listed_grams(table: pa.Table) -> pa.Table:
    """Of a block: its distinct grams with their number in training documents."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    for part in slices(table.to_batches(), limit=SLICE):
        raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
        test = part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(np.uint64)
        marked = codes(raw, offsets)[0] << np.uint64(1) | np.repeat(test, np.diff(offsets) + 1)
        keys, counts = np.unique(marked, return_counts=True)
        held.append((keys >> np.uint64(1), np.where(keys & np.uint64(1), 0, counts)))
        if sum(len(k) for k, _ in held[1:]) > FLUSH // 3:
            held = [merged()]
    keys, counts = merged()
    block = np.full(len(keys), table.column("block")[0].as_py(), dtype=np.int32)
    return pa.table({"block": block, "gram": keys.astype(np.int64), "n": counts.astype(np.int64)})


def gram_logs(counts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(gram, log): log10 probability of every gram of (gram, n), under the trie of all of them, n times each."""
    near = counts.filter("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(int(mask(NEAR)))).alias("pair")).agg(F.sum("n").alias("n")).toArrow()  # the alphabet bounds it
    pair, n = near.column("pair").to_numpy().astype(np.uint64), near.column("n").to_numpy().astype(float)
    low = counts.sparkSession.sparkContext.broadcast([_summed(pair & mask(o + 1), n) for o in range(NEAR)])

    def logs(table: pa.Table) -> pa.Table:
        grams, n = table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy()
        known = n > 0
        trie = Trie(low.value + [_summed(grams[known] & mask(o + 1), n[known]) for o in range(NEAR, DEPTH + 1)])
        return pa.table({"gram": grams.astype(np.int64), "log": trie.log10(grams)})

    context = F.shiftright("gram", BITS).bitwiseAND(F.lit(int(mask(NEAR))))
    pieces = counts.withColumn("piece", F.pmod(F.xxhash64(context), F.lit(counts.count() // piece + 1)))
    return pieces.groupBy("piece").applyInArrow(logs, "gram bigint, log double")


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER.tobytes()).split()


def _vocabulary(table: pa.Table) -> pa.Table:
    """Of a block: its distinct words, the end among them as the empty word, with their number in training documents."""
    counts: Counter = Counter()
    for text, test in zip(table.column("text").cast(pa.large_binary()).to_pylist(), table.column("held_out").to_pylist(), strict=True):
        found = [*words(text), b""]
        if test:
            for w in set(found):
                counts[w] += 0
        else:
            counts.update(found)
    return pa.table({
        "block": pa.array([table.column("block")[0].as_py()] * len(counts), pa.int32()),
        "word": pa.array(list(counts), pa.binary()),
        "n": pa.array(list(counts.values()), pa.int64()),
    })


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 10, block_bytes: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (the trie)."""
    rows = dealt(docs, id_col, text_col, block_bytes).withColumn("held_out", held_out(F.col("doc_id"), one_in))
    grams = materialise(rows.groupBy("block").applyInArrow(_listed_grams, "block int, gram bigint, n bigint"), "ppm-grams")
    logs = gram_logs(materialise(grams.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-counts"), piece)
    # The distinct grams grow with the corpus; they are met the same way at every size.
    priced = grams.select("block", "gram").join(logs.hint("merge"), "gram")
    listed = rows.groupBy("block").applyInArrow(_vocabulary, "block int, word binary, n bigint")
    by_word = Window.partitionBy("word")
    known = listed.withColumn("c", F.sum("n").over(by_word)).withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1)
    totals = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.count(F.when(F.col("first") & (F.col("c") > 0), 1)).alias("v"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _result}, schema=_result)
        own, priced = right.select(["word", "value"]).filter(right.column("gram").is_null()), right.select(["gram", "value"]).filter(right.column("gram").is_valid())
        # Above zero for words that training documents hold.
        logs = dict(zip(own.column("word").to_pylist(), np.log10(own.column("value").to_numpy() + 0.1).tolist(), strict=True))
        grams, costs = priced.column("gram").to_numpy().astype(np.uint64), priced.column("value").to_numpy()
        order = np.argsort(grams)
        grams, costs, out = grams[order], costs[order], []
        for part in slices(left.to_batches(), limit=SLICE):
            raw, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
            found, starts = codes(raw, offsets)
            distinct, at = np.unique(found, return_inverse=True)
            scores, all_ = np.add.reduceat(costs[np.searchsorted(grams, distinct)][at], starts), raw.tobytes()
            for i, (doc_id, test) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), strict=True)):
                found = [logs[w] for w in (*words(all_[offsets[i] : offsets[i + 1]]), b"")]
                out.append((doc_id, test, len(found), sum([x > 0 for x in found]), sum(found), float(scores[i])))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _result, strict=True)], schema=_result)

    needed = known.select("block", "word", F.col("c").cast("double").alias("value")).unionByName(priced.withColumnRenamed("log", "value"), allowMissingColumns=True)
    scored = rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(score, SCHEMA)
    base = F.col("base_logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("v") + 1))
    out = scored.crossJoin(F.broadcast(totals))  # totals is one row
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


_result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_logs", pa.float64()), ("score", pa.float64())])
