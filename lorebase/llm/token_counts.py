"""Token counts without token ids.

1.  Every task reads its documents into *frequency blocks* of about ``BLOCK_BYTES`` of text: the
    distinct pre-tokens of the block, and for each document which of them it has and how often.
    A block is one row of a written table; no text is shuffled.
2.  Blocks send their lists of pre-tokens in parcels, one for each slice of a hash of the
    pre-token.  In a slice each distinct pre-token of the corpus is counted once, by the library,
    and the count is joined to every block that lists it.
3.  The counts go back by block and are summed by document with the frequencies as weights.

A row for each document and pre-token would be more bytes than the documents have; a block
lists a pre-token once for all its documents, so that is what travels, packed.  A slice holds
about ``SLICE_BYTES`` of text's worth of lists, whatever the size of the corpus, and no pre-token
has more than one entry from each block.

Vocabularies that are not split into pre-tokens by the format known here (other normalizers,
``.model`` files) have no pre-tokens to count; whole texts are counted, each as one.

Defined cases: a null or empty text has 0 bytes and 0 tokens; strings of special tokens in a
text count as the library counts them by default (one token each); a very long text is a block
of its own size; repeated rows are counted each for itself; a null id stays null; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.arrow import id_and_text, slices
from lorebase.llm.blocks import blocks_for
from lorebase.storage import materialise

#: Bytes of text in a frequency block, and pre-tokens that go to the library at once.
BLOCK_BYTES, BATCH = 24_000_000, 20_000
#: Bytes of text whose lists a slice of the hash takes in.
SLICE_BYTES = 8_000_000
#: How byte-level BPE vocabularies of this family split a text (a fixed value of the format).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points from here on may be newer than the library's tables: such texts go through its own splitter.
STABLE = regex.compile("[^\x00-ԯ‐-‧]")
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: known: whether the id is one; extra: tokens besides those of pre-tokens; starts, codes, times: by document, which pre-tokens (by place in the block's list) how often.
FREQUENCIES = "block bigint, ids binary, known binary, bytes binary, extra binary, starts binary, codes binary, times binary, parcels array<struct<slice: int, ends: binary, pieces: binary, places: binary>>"
_parcel = pa.struct([("slice", pa.int32()), ("ends", pa.binary()), ("pieces", pa.binary()), ("places", pa.binary())])
_frequencies = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "known", "bytes", "extra", "starts", "codes", "times")], ("parcels", pa.list_(_parcel))])
COUNTS = "owner bigint, places binary, n binary"
_counts = pa.schema([("owner", pa.int64()), ("places", pa.binary()), ("n", pa.binary())])
_result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts the pieces of pre-tokens for one vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.splits = path, False
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        special = [t["content"] for t in self.file["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        pre = self.file.get("pre_tokenizer") or {}
        #: Whether the split above is this vocabulary's; otherwise whole texts are counted.
        self.splits = self.file.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.splits = self.splits and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in self.file["added_tokens"])

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no special token."""
        if STABLE.search(text) is None:
            return PRE_TOKEN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token is in the text, and the number of special tokens."""
        if self.special is None or self.special.search(text) is None:
            return Counter(self.pre_tokens(text)), 0
        parts = self.special.split(text)
        found = Counter()
        for part in parts:
            found.update(self.pre_tokens(part))
        return found, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """How many tokens the library makes of each text or pre-token."""
        if self.sentencepiece:
            return [len(self.library.encode(x)) for x in texts]
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class Block:
    """Documents read so far, their distinct pre-tokens and frequencies."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.known, self.bytes, self.extra, self.sizes, self.codes, self.times = [], [], [], [], [], [], []
        self.held = 0

    def add(self, counter: PieceCounter, doc_id: int | None, text: str, size: int) -> None:
        place = self.place
        if counter.splits:
            found, extra = counter.frequencies(text)
            codes = np.array([place.setdefault(piece, len(place)) for piece in found], np.int64)
            order = np.argsort(codes)
            self.codes.append(np.diff(codes[order], prepend=0))
            self.times.append(np.array(list(found.values()), np.int64)[order])
        else:
            extra = counter.count([text])[0]
        self.sizes.append(len(found) if counter.splits else 0)
        self.ids.append(0 if doc_id is None else doc_id)
        self.known.append(doc_id is not None)
        self.bytes.append(size)
        self.extra.append(extra)
        self.held += size

    def row(self, number: int, slices_: int) -> pa.RecordBatch:
        packed = lambda x, kind: np.array(x, kind).tobytes()
        joined = lambda x: planes(np.concatenate(x)) if x else b""
        out = {
            "block": number, "ids": packed(self.ids, np.int64), "known": packed(self.known, bool), "bytes": packed(self.bytes, np.int64), "extra": packed(self.extra, np.int64),
            "starts": np.cumsum([0, *self.sizes]).tobytes(), "codes": joined(self.codes), "times": joined(self.times), "parcels": [],
        }
        pieces = [piece.encode() for piece in self.place]
        slice_ = np.array([xxhash.xxh64_intdigest(p) % slices_ for p in pieces], np.int32)
        order = np.argsort(slice_, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(slice_[order])) + 1) if len(order) else ():
            own = [pieces[i] for i in group.tolist()]
            out["parcels"].append({"slice": int(slice_[group[0]]), "ends": packed(np.cumsum([len(p) for p in own]), np.int32), "pieces": b"".join(own), "places": packed(group, np.int32)})
        return pa.RecordBatch.from_pylist([out], schema=_frequencies)


def planes(values: np.ndarray) -> bytes:
    """32-bit integers as all their lowest bytes, then all the next, and so on: small ones leave planes of zeros, which compress to nothing."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def counter(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""

    rows = id_and_text(docs, id_col, text_col)
    slices_ = blocks_for(docs, text_col, SLICE_BYTES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), TaskContext.get().partitionId() << 32
        for part in slices(batches):
            ids, texts, sizes = part.column(0).cast(pa.int64()).to_pylist(), part.column(1).to_pylist(), pc.binary_length(part.column(1)).to_pylist()
            for doc_id, text, size in zip(ids, texts, sizes, strict=True):
                block.add(counter(tokenizer_path), doc_id, text, size)
                if block.held >= block_bytes:
                    yield block.row(number, slices_)
                    block, number = Block(), number + 1
        if block.ids:
            yield block.row(number, slices_)

    def counted(parcels: pa.Table) -> pa.Table:
        """Each distinct pre-token of a slice once, and its count for every block that lists it."""
        lists = []
        for ends, data in zip(parcels.column("ends").to_pylist(), parcels.column("pieces").to_pylist(), strict=True):
            offsets = np.concatenate([[0], np.frombuffer(ends, np.int32)]).astype(np.int32)
            lists.append(pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        coded = pa.concat_arrays(lists).dictionary_encode()
        own = coded.dictionary.to_pylist()
        n = np.array([x for a in range(0, len(own), BATCH) for x in counter(tokenizer_path).count(own[a : a + BATCH])], np.uint32)
        each = np.split(n[coded.indices.to_numpy()], np.cumsum([len(x) for x in lists])[:-1])
        return pa.table([parcels.column("owner"), parcels.column("places"), pa.array([planes(x) for x in each], pa.binary())], schema=_counts)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _result.empty_table()
        row = left.to_pylist()[0]
        own = lambda c: np.frombuffer(row[c], np.int64)
        places = [np.frombuffer(x, np.int32) for x in right.column("places").to_pylist()]
        n = np.zeros(sum(map(len, places)), np.int64)
        for at, x in zip(places, right.column("n").to_pylist(), strict=True):
            n[at] = from_planes(x)
        starts, steps = own("starts"), from_planes(row["codes"]).astype(np.int64)
        # Codes are steps from one to the next within a document.
        codes = np.cumsum(steps)
        first = starts[:-1][np.diff(starts) > 0]
        codes -= np.repeat(codes[first] - steps[first], np.diff(starts)[np.diff(starts) > 0])
        sums = np.concatenate([[0], np.cumsum(n[codes] * from_planes(row["times"]))])
        tokens = sums[starts[1:]] - sums[starts[:-1]] + own("extra")
        return pa.table([pa.array(own("ids"), mask=~np.frombuffer(row["known"], bool)), pa.array(own("bytes")), pa.array(tokens), pa.array(tokens > limit)], schema=_result)

    blocks = materialise(rows.mapInArrow(read, FREQUENCIES), "token-frequencies", "zstd")
    parcels = blocks.select(F.col("block").alias("owner"), F.explode("parcels").alias("p")).select("owner", "p.*")
    priced = parcels.groupBy("slice").applyInArrow(counted, COUNTS)
    return blocks.drop("parcels").groupBy("block").cogroup(priced.groupBy("owner")).applyInArrow(summed, SCHEMA)
