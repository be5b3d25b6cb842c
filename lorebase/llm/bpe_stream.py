"""BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

A merge list has a *sufficient lookahead*: a number of bytes such that what follows further
away can't change how the text before is cut.  Influence travels to the left only through a
chain of merges of strictly later rank, each of which has its right operand where the one
before ended; :func:`sufficient_lookahead` bounds the bytes that the longest chain spans, by
one pass over the merges from the last to the first.  A boundary that lies further than that
from the end of the buffered bytes is therefore final, and as no merge crosses it, both sides
are cut alike whether they are seen together or apart: tokens before it are emitted and their
bytes forgotten.  The buffer is constant, however long a word is.

Words repeat, so a worker keeps the ids of up to ``KEEP`` distinct words.

Decoding reads nothing but ids.  :class:`Decoder` turns each id into its bytes and the bytes into
text as they arrive; between two pushes it holds one flag and an unfinished character.

Defined cases: a null or empty text gives no ids and an empty decoded text; strings of special
tokens in a text become their ids as the library does by default; a very long text or word passes
in pieces, beside its own ids; repeated rows are encoded each for itself; a null id stays null; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import struct
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lorebase.llm.arrow import id_and_text, map_slices

#: Distinct words whose ids a worker keeps.
KEEP = 300_000
#: Ids that the decoder takes at once.
STEP = 4096
#: Texts with code points from here on are normalised and split by the library, whose Unicode tables may differ.
UNSTABLE = regex.compile("[^\x00-ԯ‐-‧]")
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
#: In a merge's entry: the bits of the token; and an entry that never comes due.
TOKEN, NEVER = (1 << 24) - 1, 1 << 62
_loaded: dict[str, "Transducer"] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: list[int]) -> int:
    """Bytes of lookahead after which a boundary is final.

    merges: (left, right, result) by rank; length: bytes of each token.  reach[t]: the most
    bytes to the left of a token t that merges of later rank can still affect once t's
    presence is in doubt.  Going from the last merge to the first, every merge read so far is
    of later rank.
    """
    reach = [0] * len(length)
    for left, right, result in reversed(merges):
        onward = length[left] + max(reach[result], reach[left])
        beside = reach[result]
        reach[right] = max(reach[right], onward)
        reach[left] = max(reach[left], beside)
    return max(length, default=0) + max(reach, default=0)


class Transducer:
    """Encodes and decodes with one vocabulary file of the BPE kind."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special_id = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.letters = byte_alphabet()
        #: A byte-level decoder joins the bytes that tokens stand for; without a decoder the tokens themselves are joined by blanks.
        of_letter = {c: b for b, c in enumerate(self.letters)}
        plain = (file.get("decoder") or {}).get("type") != "ByteLevel"
        self.bytes_of = {i: t.encode() if plain else bytes(of_letter[c] for c in t) for t, i in self.vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special_id.items()}
        self.between = b" " if plain else b""
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.special_id, key=len, reverse=True)))) if self.special_id else None
        self.byte_id = [self.vocab.get(c) for c in self.letters]
        self.last_id = [self.vocab.get(c + self.suffix) for c in self.letters]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Of a pair of tokens: the merge's rank, and below it in TOKEN's bits the token that it makes.
        self.rank: dict[tuple[int, int], int] = {}
        triples = []
        for k, (a, b) in enumerate(pairs):
            left, right, result = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = k << 24 | result
            triples.append((left, right, result))
        size = max(self.vocab.values()) + 1
        self.length = [0] * size
        for t, i in self.vocab.items():
            self.length[i] = len(t) - (len(self.suffix) if self.suffix and t.endswith(self.suffix) else 0)
        self.lookahead = sufficient_lookahead(triples, self.length)
        steps = file["normalizer"]["normalizers"]
        self.known_steps = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        split = file["pre_tokenizer"]["pretokenizers"][0]
        self.words_of = regex.compile(split["pattern"]["Regex"])
        self.known: dict[str, bytes] = {}

    # -- one word ---------------------------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to ids by rank, leftmost first."""
        rank = self.rank
        if len(ids) < 64:
            ids, get = list(ids), rank.get
            due = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
            while due and (first := min(due)) < NEVER:
                i = due.index(first)
                ids[i] = first & TOKEN
                del ids[i + 1], due[i]
                if i < len(due):
                    due[i] = get((ids[i], ids[i + 1]), NEVER)
                if i:
                    due[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            return ids
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        ids = list(ids)
        while heap:
            due, i, a, b = heappop(heap)
            result = due & TOKEN
            if not alive[i] or ids[i] != a:
                continue
            j = after[i]
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = result, False, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (r := rank.get((result, ids[after[j]]))) is not None:
                    heappush(heap, (r, i, result, ids[after[j]]))
            if before[i] >= 0 and (r := rank.get((ids[before[i]], result))) is not None:
                heappush(heap, (r, before[i], ids[before[i]], result))
        return [x for x, y in zip(ids, alive, strict=True) if y]

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """The ids of one word that arrives in pieces, each emitted as soon as it is final."""
        held = b""
        keep = self.lookahead
        for piece in pieces:
            held += piece
            if len(held) < 4 * keep:
                continue
            ids = self.merge([self.byte_id[b] for b in held])
            final, done = len(held) - keep, 0
            for i in ids:
                if done + self.length[i] > final:
                    break
                done += self.length[i]
                yield i
            held = held[done:]
        if held:
            ids = [self.byte_id[b] for b in held]
            ids[-1] = self.last_id[held[-1]]
            yield from self.merge([i for i in ids if i is not None])

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit integers."""
        raw, step = word.encode(), self.lookahead
        ids = list(self.stream([raw] if len(raw) <= step else (raw[i : i + step] for i in range(0, len(raw), step))))
        return struct.pack(f"<{len(ids)}I", *ids)

    # -- texts ------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if self.known_steps and UNSTABLE.search(text) is None:
            if not text.isascii():
                if not is_normalized("NFC", text):
                    text = normalize("NFC", text)
                text = text.replace("Σ", "σ")
            return self.words_of.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if self.special is None or self.special.search(text) is None:
            return b"".join(self.lookup(self.words(text)))
        found, at = [], 0
        for m in self.special.finditer(text):
            found += self.lookup(self.words(text[at : m.start()]))
            found.append(struct.pack("<I", self.special_id[m[0]]))
            at = m.end()
        return b"".join(found + self.lookup(self.words(text[at:])))

    def lookup(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > KEEP:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.word(w)
        return [known[w] for w in words]

    def decoder(self) -> "Decoder":
        return Decoder(self.bytes_of, self.between)

    def decode(self, ids: Sequence[int]) -> str:
        """What the library makes of ids, in one piece."""
        decoder = self.decoder()
        return decoder.push(ids) + decoder.finish()


class Decoder:
    """Ids to text as they arrive: a state machine from bytes to text.

    Its state is whether a token has come before, and the bytes of an unfinished UTF-8 sequence, 3
    at most.  bytes_of: what each id stands for; ids it doesn't have are left out.  between: what
    stands between two tokens.
    """

    def __init__(self, bytes_of: dict[int, bytes], between: bytes = b"") -> None:
        self.bytes_of, self.between, self.begun = bytes_of, between, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Sequence[int]) -> str:
        try:
            pieces = list(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            pieces = [self.bytes_of[i] for i in ids if i in self.bytes_of]
        if not pieces:
            return ""
        raw = self.between * self.begun + self.between.join(pieces)
        self.begun = True
        return self.utf8.decode(raw)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def pieces(decoder: Decoder, ids: np.ndarray) -> Iterator[str]:
    """The text of ids, STEP of them at a time."""
    for i in range(0, len(ids), STEP):
        yield decoder.push(ids[i : i + STEP].tolist())
    yield decoder.finish()


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", payload: bool = True) -> DataFrame:
    """Per document: number of tokens, digests of its ids and of what they decode to.

    payload: also return the ids (little-endian unsigned 32-bit integers) and the decoded text.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = transducer(tokenizer_path)
        every = [t.encode(x) for x in batch.column(1).to_pylist()]
        digests, decoded = [], []
        for ids in every:
            digest, text = hashlib.sha256(), []
            for piece in pieces(t.decoder(), np.frombuffer(ids, "<u4")):
                digest.update(piece.encode())
                if payload:
                    text.append(piece)
            digests.append(digest.hexdigest())
            decoded.append("".join(text))
        columns = [
            batch.column(0).cast(pa.int64()),
            pa.array([len(ids) // 4 for ids in every], pa.int64()),
            pa.array([hashlib.sha256(ids).hexdigest() for ids in every], pa.string()),
            pa.array(digests, pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if payload:
            columns += [pa.array(every, pa.binary()), pa.array(decoded, pa.string())]
            names += ["ids", "decoded"]
        return pa.record_batch(columns, names=names)

    schema = SCHEMA if payload else SCHEMA.split(", ids ")[0]
    return map_slices(id_and_text(docs, id_col, text_col), work, schema)
