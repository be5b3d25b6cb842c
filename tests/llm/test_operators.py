"""Each operator against a brute-force version, on hostile little tables."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lorebase.llm import bpe_stream, mixing, pii, ppm, quality, search, simhash, substring_dedup, suffix_dedup, token_counts
from lorebase.llm.components import components
from lorebase.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


# -- 1 ------------------------------------------------------------------------------------------


def classes(values):
    ids, parent = sorted(values), {i: i for i in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (values[a] ^ values[b]).bit_count() <= 3:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def plain_fingerprint(text, n=3):
    w = words(lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows):
    got = by_id(simhash.near_duplicates(docs))
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    assert {i: g.fingerprint for i, g in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: g.component_id for i, g in got.items()} == classes(prints)


def test_blocks_leave_no_three_positions_uncovered():
    assert len(simhash.BLOCKS) == 14
    assert all(any(not set(b) & set(differ) for b in simhash.BLOCKS) for differ in itertools.combinations(range(8), 3))


def test_long_lists_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 8)
    rng, prints = random.Random(3), set()
    base = rng.getrandbits(64)
    for _ in range(60):
        prints.add(base ^ sum(1 << b for b in rng.sample(range(16), rng.randint(0, 6))))
    prints |= {rng.getrandbits(64) for _ in range(30)}
    values = {simhash.signed(p): p for p in prints}
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"))
    roots = {r.node: r.root for r in components(links).collect()}
    assert {v: roots.get(v, v) for v in values} == classes(values)


def test_a_large_list_at_its_default_size(spark):
    """Four thousand near copies of one fingerprint, and far copies that share half their bytes with them."""
    rng = random.Random(11)
    base, prints = rng.getrandbits(64), set()
    while len(prints) < 4000:
        prints.add(base ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 4))))
    prints |= {base & ((1 << 32) - 1) | rng.getrandbits(32) << 32 for _ in range(40)}
    links = simhash.links(spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint"))
    roots = {r.node: r.root for r in components(links).collect()}
    # Brute force by the neighbours that three flipped bits reach.
    flips = [sum(1 << b for b in c) for n in (1, 2, 3) for c in itertools.combinations(range(24), n)]
    todo, parts = set(prints), {}
    while todo:
        part = [todo.pop()]
        for x in part:
            near = {x ^ f for f in flips if x ^ f in todo} | {y for y in todo if (x ^ y) >> 32 and (x ^ y).bit_count() <= 3}
            todo -= near
            part += near
        parts |= dict.fromkeys(part, min(simhash.signed(x) for x in part))
    assert {p: roots.get(simhash.signed(p), simhash.signed(p)) for p in prints} == parts


def test_one_of_each(docs, rows):
    kept = simhash.one_of_each(docs).collect()
    prints = {r.doc_id: plain_fingerprint(r.text, 5) for r in rows}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(classes(prints).values()))


def similar(texts, least=0.8):
    """By id: the smallest id of its class, classes joining sets of five-word shingles of that Jaccard similarity."""
    sets = {}
    for i, text in texts.items():
        w = words(lower(text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        either = sets[a] | sets[b]
        if not either or len(sets[a] & sets[b]) >= least * len(either) - 1e-12:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_one_of_each_at_a_similarity(spark, docs, rows):
    kept = simhash.one_of_each(docs, similarity=0.8).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(similar({r.doc_id: r.text for r in rows}).values()))
    rng, texts = random.Random(8), {}
    # Clusters of edited copies, from a few words to hundreds, near the bound on either side; a passage that all share; one text copied very often.
    passage = " ".join(f"p{j}" for j in range(40))
    for c in range(60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 6, 12, 40, 120, 300]))] + (passage.split() if c % 2 else [])
        for _ in range(rng.choice([1, 3, 6])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**6)}"
            texts[len(texts)] = " ".join(own)
    base = [f"h{j}" for j in range(150)]
    for _ in range(150):
        own = list(base)
        own[rng.randrange(150)] = f"e{rng.randint(0, 10**6)}"
        texts[len(texts)] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got, want = sorted(r.doc_id for r in simhash.one_of_each(df, similarity=0.8).collect()), sorted(set(similar(texts).values()))
    assert got == want


def test_slices_of_similar_texts_agree():
    rng = np.random.default_rng(6)
    from lorebase.llm import sliced

    for n in (2, 4, 5, 9, 20, 33, 64, 127, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for least in (0.8, 0.9):
            apart = int(len(a) * (1 - least))
            b = np.unique(np.concatenate([a[apart:], rng.integers(0, 1 << 63, 0, dtype=np.uint64)]))
            one, two = ({tuple(p.values()) for p in sliced.postings(x, least)} for x in (a, b))
            assert one & two and len(one) <= 3 * sliced.POSITIONS


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a bigint, b bigint")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_one_of_each_component_stays_when_ids_repeat(spark):
    a, b, c, d = ("stone river cloud " * 9, "light shadow moss fern " * 9, "nine old ships sail north " * 9, "no name at all here " * 9)
    given = [(1, a), (2, a), (1, b), (3, b), (3, c), (4, c), (5, "five plain words stand alone"), (None, d), (None, d), (None, "alone without any id")]
    fp = {t: plain_fingerprint(t, 5) for _, t in given}
    assert all((fp[x] ^ fp[y]).bit_count() > 3 for x, y in itertools.combinations(fp, 2))
    df = spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in simhash.one_of_each(df).collect()]
    want = [(1, a), (1, b), (3, c), (5, "five plain words stand alone"), (None, d), (None, "alone without any id")]
    assert Counter(got) == Counter(want)


# -- 2 ------------------------------------------------------------------------------------------


def test_quality_signals(docs, rows):
    got = by_id(quality.quality(docs))
    for r in rows:
        w, lines = words(r.text), [x for x in (r.text or "").split("\n") if words(x)]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        g = got[r.doc_id]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (g.base_failed and g.kept)


def test_expectation_maximisation_separates_junk_from_clean():
    votes = {(1, 1, 1): 800, (1, 0, 1): 60, (-1, 1, 1): 30, (-1, -1, 1): 40, (1, -1, -1): 30}
    odds, add = quality.estimate(votes)
    score = lambda v: odds + sum(a[x] for a, x in zip(add, v, strict=True))
    assert score((1, 1, 1)) > 0 > score((-1, -1, 1)) and score((0, 0, 0)) == odds > 0
    assert quality.estimate({})[0] > 0


def test_clean_labels_are_kept(spark):
    from tests.conftest import SF

    found = quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).filter("not base_failed").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert found.filter("quality = 1 and not kept").count() == 0
    assert found.filter("quality = 0 and kept").count() == 0


# -- 3 ------------------------------------------------------------------------------------------


def test_knapsack_equals_enumeration():
    rng = random.Random(0)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(15), rng.randint(1, 4))))
        counts, budget = np.array([rng.randint(1, 3) for _ in sizes]), rng.randint(0, 60)
        take = mixing.knapsack(sizes, counts, budget)
        sums = {sum(a * b for a, b in zip(x, sizes, strict=True)) for x in itertools.product(*[range(c + 1) for c in counts])}
        assert (take <= counts).all() and (take * sizes).sum() == max(s for s in sums if s <= budget)


def test_a_very_long_text_leaves_the_knapsack_small(monkeypatch):
    monkeypatch.setattr(mixing, "EXACT", 50)
    lengths, counts = np.array([1, 7, 10, 4000, 900_000]), np.array([40, 30, 20, 6, 1])
    for budget in (30, 500, 20_000, 910_000):
        asked = []
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing, "knapsack", lambda sizes, free, left, f=mixing.knapsack: (asked.append(left), f(sizes, free, left))[1])
            take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and max(asked, default=0) <= 50
        assert 0 <= budget - int((take * lengths).sum()) < 4000 or (take == counts)[:-1].all()


def test_targets_stop_at_the_cap_and_share_the_rest():
    t = mixing.targets({"a": 10, "b": 100, None: 100}, (3, 1, 2), 1.5, 2)
    assert t == {"a": 20.0, "b": pytest.approx(295 / 3), None: pytest.approx(590 / 3)}
    assert mixing.targets({}, (1,), 1.5, 2) == {}


def test_mix(docs):
    once, again = mixing.mix(docs).collect(), mixing.mix(docs).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, once)) == sorted(map(key, again)) and len(once) == docs.count()
    texts = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    by_source = defaultdict(lambda: [0, 0.0])
    for r in once:
        assert r.taken in (0, r.size, 2 * r.size) and (r.doc_id is None or r.size == texts[r.doc_id])
        by_source[r.source][0] += r.taken
        by_source[r.source][1] = r.target
    assert len(by_source) == 4 and all(abs(t - g) <= 5 for t, g in by_source.values())


def test_mix_keeps_columns(docs):
    mixed = mixing.repeated(mixing.mix(docs, keep=docs.columns)).select("row.*")
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in docs.collect()}


# -- 4 and 10 -----------------------------------------------------------------------------------

ODD = ["a" * 5000, "é" * 3000, "it's  we'll\n\n x", "<|endoftext|> a <|endoftext|>", "\x1c\x85  b", "ΣΑΣ İ ﬁ", "é 日本語 😀", "", " "]


@pytest.mark.parametrize(("file", "block_bytes"), [("byte_bpe_50k.json", 12_000_000), ("byte_bpe_50k.json", 2000), ("word_bpe_49k.json", 2000)])
def test_token_counts_equal_the_library(spark, docs, file, block_bytes):
    """Every row, repeated ones and those without an id among them, in one block and in many."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(file))
    odd = spark.createDataFrame([(900 + i, t) for i, t in enumerate([*ODD, "word " * 40_000])], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(odd).unionByName(odd.limit(3))
    got = token_counts.token_counts(every, tokenizer(file), block_bytes=block_bytes).collect()
    want = []
    for r in every.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert Counter(map(tuple, got)) == Counter(want)


def test_sentencepiece_counts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    assert token_counts.counter(tokenizer("piece_bpe_32k.model")).count(ODD) == [len(library.encode(x)) for x in ODD]


def test_bpe_round_trip_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = by_id(bpe_stream.bpe_round_trip(docs, path))
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False)))
        assert bpe_stream.transducer(path).decode(ids) == g.decoded
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe_stream.transducer(path).encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert bpe_stream.transducer(path).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rare_code_points_split_as_the_library_does():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library, t = Tokenizer.from_file(path), bpe_stream.transducer(path)
    for start in range(0x80, 0x32000, 97):
        text = " ".join(f"a{chr(c)}1{chr(c)}" for c in range(start, start + 97) if not 0xD800 <= c < 0xE000)
        ids = library.encode(text, add_special_tokens=False).ids
        assert t.encode(text) == struct.pack(f"<{len(ids)}I", *ids), hex(start)


def test_lookahead_is_enough_for_long_words():
    t, rng = bpe_stream.transducer(tokenizer("word_bpe_49k.json")), random.Random(1)
    for alphabet in ("etaoinshr", "ab", "0123!?", "aé日"):
        raw = "".join(rng.choice(alphabet) for _ in range(4000)).encode()
        whole = t.merge([*(t.byte_id[b] for b in raw[:-1]), t.last_id[raw[-1]]])
        assert list(t.stream(raw[i : i + 7] for i in range(0, len(raw), 7))) == whole


def test_decoder_holds_back_unfinished_characters():
    raw = "naïve 日本 😀".encode()
    of = {i: raw[i : i + 1] for i in range(len(raw))}
    decoder = bpe_stream.Decoder(of)
    assert "".join(decoder.push([i]) for i in of) + decoder.finish() == "naïve 日本 😀"
    decoder = bpe_stream.Decoder({1: b"a</w>", 2: "é".encode()}, b" ")
    assert decoder.push([1]) + decoder.push([]) + decoder.push([2, 9, 1]) + decoder.finish() == "a</w> é a</w>"


# -- 5 ------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(s))) % 10 == 0
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good[k](m[0])]


def test_pii(spark, docs):
    hard = ["a@b.com%x@c.de 1.2.3.4.5.6.7.8 é 999.1.1.1 0255.0.0.1", "4111-1111-1111-1111-1+49 30 12345678é@a.b-c.d_e@f.g.", "x" * 50000 + "@", "1" * 30000, "a.b@c" * 500 + ".de", "+1(2)3-4 +12345678 4111111111111111 5500 0000 0000 0004"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hard)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    got = by_id(pii.pii_spans(every))
    for r in every.collect():
        if r.doc_id is None:
            continue
        want = plain_spans(r.text)
        g = got[r.doc_id]
        assert g.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == x for x, *_ in want) for k in PLAIN]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(g.spans.split(","))


def test_added_kinds_need_a_checksum_or_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32", "iban GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "part 123-45-6789", 'token = "0123456789abcdef0123456789abcdef"', "commit 0123456789abcdef0123456789abcdef"]
    found = by_id(pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert [bool(re.search("iban|ssn|secret", found[i].spans)) for i in range(6)] == [True, False, True, False, True, False]


def test_accounts_end_where_their_country_says(spark):
    account = "GB82 WEST 1234 5698 7654 32"
    texts = [f"{account} now", f"{account} BIC DEUTDEFF", f"{account} AND MORE", f"{account} DE89370400440532013000", f"{account}1 A", "XX82 WEST 1234 5698 7654 32", "NO9386011117947."]
    found = by_id(pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    whole = "iban:0:27"
    assert [found[i].spans for i in range(7)] == [whole, whole, whole, f"{whole},iban:28:50", "", "", "iban:0:15"]


def test_redact(docs, rows):
    out = by_id(pii.redact(docs))
    assert out[305].text == "mail [EMAIL] from [IP] card [CARD] call [PHONE] <|endoftext|>" and out[300].text is None
    assert all(out[r.doc_id].text == r.text for r in rows if not plain_spans(r.text))


# -- 6 and 7 ------------------------------------------------------------------------------------


def repeats(units, length, seen):
    gone = [False] * len(units)
    for i in range(len(units) - length + 1):
        key = tuple(units[i : i + length])
        if key in seen:
            gone[i : i + length] = [True] * length
        seen.add(key)
    return gone


@pytest.mark.parametrize("most", [1024, 3, 1])
def test_substring_dedup(docs, rows, most):
    got, seen = by_id(substring_dedup.remove_repeated_words(docs, most=most)), set()
    for r in sorted(rows):
        w = words(r.text)
        gone = repeats(w, 20, seen)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        g = got[r.doc_id]
        assert (g.n_words, g.n_removed, g.kept_sha256, g.kept) == (len(w), sum(gone), sha(kept), kept)


@pytest.mark.parametrize("most", [1024, 3, 1])
def test_suffix_dedup(docs, rows, most):
    got, seen = by_id(suffix_dedup.remove_repeated_bytes(docs, most=most)), set()
    for r in sorted(rows):
        raw = (r.text or "").encode()
        gone = repeats(raw, 100, seen)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len(raw), sum(gone), runs, sha(bytes(b for b, x in zip(raw, gone, strict=True) if not x)))


def test_boundaries_equal_common_prefixes():
    rng = random.Random(2)
    for _ in range(30):
        text = np.array([*(rng.choice([0, 1, 1, 2, 3]) for _ in range(80)), 0])
        order = suffix_dedup.suffix_array(text, 8)
        marked = suffix_dedup.boundaries(text, order, 5)
        whole = lambda p: p + 5 <= len(text) and (text[p : p + 5] != 0).all()
        for i in range(1, len(text)):
            a, b = order[i - 1], order[i]
            if whole(a) or whole(b):
                assert marked[i] == (text[a : a + 5].tolist() != text[b : b + 5].tolist())


# -- 8 ------------------------------------------------------------------------------------------


def plain_search(rows, k, asking=lambda r: True):
    """By place among rows that ask: the k best (doc_id, score), ties and null ids as stated."""
    counts = [Counter(words(lower(r.text))) for r in rows]
    n, mean = len(rows), sum(sum(c.values()) for c in counts) / len(rows)
    df = Counter(t for c in counts for t in c)
    out = []
    sizes = [sum(c.values()) for c in counts]
    for asked in (c for r, c in zip(rows, counts, strict=True) if asking(r)):
        scores = []
        for r, c, size in zip(rows, counts, sizes, strict=True):
            hit = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * m * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t, m in asked.items() if t in c]
            if hit:
                scores.append((r.doc_id, round(sum(hit), 6)))
        out.append(sorted(scores, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k])
    return out


@pytest.mark.parametrize(("shard_bytes", "k"), [(1 << 30, 3), (3000, 3), (3000, 40), (500, 1)])
def test_search(docs, shard_bytes, k, monkeypatch):
    """All rows ask, null and repeated ids among them, over one shard and many."""
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "PACK", 3)
    twice = docs.unionByName(docs.filter("doc_id in (1, 2, 205)"))
    rows, got = twice.collect(), defaultdict(list)
    for r in search.top_k(twice, twice["doc_id"].isNull() | (twice["doc_id"] >= 0), k=k, shard_bytes=shard_bytes).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    want = defaultdict(list)
    for r, found in zip(rows, plain_search(rows, k), strict=True):
        want[r.doc_id] += [(i + 1, d, s) for i, (d, s) in enumerate(found)]
    assert got.keys() == {i for i, x in want.items() if x}
    for i, found in got.items():
        key = lambda x: (x[0], -x[2], x[1] is None, x[1] or 0)
        assert [(x[0], pytest.approx(x[2], abs=2e-6)) for x in sorted(want[i], key=key)] == [(x[0], x[2]) for x in sorted(found, key=key)]
        exact = Counter(x[:2] for x in found) == Counter(x[:2] for x in want[i])
        assert exact or len({x[2] for x in want[i]}) < len(want[i]) or any(abs(a[2] - b[2]) < 2e-6 for a, b in itertools.pairwise(sorted(want[i], key=lambda x: x[2])))


def test_search_over_shards_of_several_slices(spark):
    """A shard of 5 MB is read in three slices; every document of it is indexed and found."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"W{x}" for x in rng.zipf(1.3, 5500) % 5000) + f" own{i // 2}" * 40 for i in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    assert sum(map(len, texts)) > 4 * 2**20
    rows, got = df.filter("doc_id % 50 = 0").collect(), by_query(search.top_k(df, df["doc_id"] % 50 == 0, k=4, shard_bytes=1 << 30))
    want = plain_search(df.collect(), 4, lambda r: r.doc_id % 50 == 0)
    assert got == {r.doc_id: [(d, pytest.approx(s, abs=2e-6)) for d, s in found] for r, found in zip(rows, want, strict=True)}


def by_query(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.doc_id, r.score))
    return out


def test_pruned_blocks_hold_nothing_better():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f", "g", f"r{i}"], rng.integers(1, 30))) for i in range(3000)]
    group = search.pa.table({"block": search.pa.array([0] * 3000, search.pa.int32()), "doc_id": range(3000), "text": texts, "asked": [True] * 3000})
    shard = search.Shard(next(search.scalars(search._indexed(group).to_batches())), 10.0)
    for _ in range(40):
        terms = rng.choice(len(shard.terms), rng.integers(1, 12), replace=False)
        weights = rng.random(len(terms)) * 3
        whole = np.zeros(3000)
        for t, w in zip(terms, weights, strict=True):
            at = slice(shard.starts[t], shard.starts[t + 1])
            whole[shard.docs[at]] += w * shard.adds[at]
        docs, scores = shard.best(terms, weights, 10)
        cut = np.sort(whole)[-10]
        assert set(np.flatnonzero(whole > cut + 1e-9)) <= set(docs.tolist()) and scores == pytest.approx(whole[docs])
        assert set(shard.best(terms, weights, 10, cut)[0].tolist()) >= set(np.flatnonzero(whole > cut + 1e-9))


@pytest.mark.parametrize(("common", "table", "scores", "at_once"), [(16, 4_000_000, 2_000_000, 1_000_000), (4, 9000, 6000, 50), (1, 0, 1, 1)])
def test_queries_of_a_shard_are_scored_together(monkeypatch, common, table, scores, at_once):
    """Batches of queries, their terms in the table or not, against sums by term; terms that the shard lacks, queries without any, blocks that none needs."""
    for name, value in (("COMMON", common), ("TABLE", table), ("SCORES", scores), ("AT_ONCE", at_once)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "b", "c", *"defg"[: 1 + i // 400], f"r{i % 700}"], rng.integers(1, 30))) for i in range(1500)]
    group = search.pa.table({"block": search.pa.array([0] * 1500, search.pa.int32()), "doc_id": range(1500), "text": texts, "asked": [True] * 1500})
    shard = search.Shard(next(search.scalars(search._indexed(group).to_batches())), 10.0)
    terms = [rng.choice(len(shard.terms), n, replace=False) for n in (0, 1, 1, 5, 40, 300, 12, 0)] + [np.array([-1, -1]), np.array([-1, 3])]
    weights = [rng.random(len(t)) * 3 for t in terms]
    whole = np.zeros((len(terms), 1500))
    for i, (own, by) in enumerate(zip(terms, weights, strict=True)):
        for t, w in zip(own[own >= 0], by[own >= 0], strict=True):
            at = slice(shard.starts[t], shard.starts[t + 1])
            whole[i, shard.docs[at]] += w * shard.adds[at]
    cut = np.sort(whole)[:, -10]
    for least in (np.zeros(len(terms)), cut, cut + 1.0, np.where(np.arange(len(terms)) == 4, cut, 1e9)):
        got = {i: (docs, sums) for i, docs, sums in shard.each(np.cumsum([0, *map(len, terms)]), np.concatenate(terms), np.concatenate(weights), 10, least)}
        for i in range(len(terms)):
            docs, sums = got.get(i, (np.zeros(0, int), np.zeros(0)))
            better = np.flatnonzero((whole[i] > 0) & (whole[i] > max(cut[i], least[i]) + 1e-9))
            assert set(better) <= set(docs.tolist()) and sums == pytest.approx(whole[i, docs]) and len(set(docs.tolist())) == len(docs)
            assert not len(docs) or whole[i, docs].min() >= max(least[i], cut[i] if (whole[i] >= max(least[i], 1e-300)).sum() > 10 else 0) - 1e-5


# -- 9 ------------------------------------------------------------------------------------------


def test_lm_scores(docs, rows):
    named = docs.filter("doc_id is not null")
    got = by_id(ppm.lm_scores(named))
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    tokens = lambda r: [*words(lower(r.text)), None]
    counts = Counter(t for r in train for t in tokens(r))
    n, v = sum(counts.values()), len(counts)
    seen = defaultdict(Counter)
    symbols = lambda r: [257] * 5 + list(lower(r.text).encode()) + [256]
    for r in train:
        s = symbols(r)
        for i, o in itertools.product(range(5, len(s)), range(6)):
            seen[tuple(s[i - o : i])][s[i]] += 1
    for r in rows[:40]:
        s, total = symbols(r), 0.0
        for i in range(5, len(s)):
            out, done = set(), False
            for o in range(5, -1, -1):
                here = seen.get(tuple(s[i - o : i]))
                if here:
                    free = {k: c for k, c in here.items() if k not in out}
                    if s[i] in free:
                        total += math.log10(free[s[i]] / (sum(free.values()) + len(free)))
                        done = True
                        break
                    total += math.log10(len(free) / (sum(free.values()) + len(free))) if free else 0
                    out = set(here)
            total -= 0 if done else math.log10(257 - len(out))
        t, g = tokens(r), got[r.doc_id]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(counts[x] > 0 for x in t), n)
        assert g.base_score == pytest.approx(base) and g.score == pytest.approx(total)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def whole_trie(texts):
    """One trie of all texts in memory."""
    data = [t.encode() for t in texts]
    grams, n = np.unique(ppm.codes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))[0], return_counts=True)
    return ppm.Trie([ppm._summed(grams & ppm.mask(o + 1), n.astype(float)) for o in range(ppm.DEPTH + 1)])


def test_every_pair_of_a_large_corpus_counts(spark):
    """Common words beyond 2^21 symbols leave a pair seen once in its place; blocks and pieces of any size agree."""
    common = [(i, "stone river cloud " * 12_000, "s") for i in range(12)]
    rare = [(100 + i, f"zq{i} wxv{i}k", "s") for i in range(20)]
    df = spark.createDataFrame(common + rare, "doc_id bigint, text string, source string")
    trie = whole_trie([r.text for r in df.filter(~ppm.held_out(df.doc_id)).collect()])
    assert sum(trie.pairs[0][1]) > 1 << 21
    want = {i: trie.log10(ppm.codes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]).sum() for i, text, _ in rare}
    once = by_id(ppm.lm_scores(df))
    assert {i: once[i].score for i in want} == pytest.approx(want)
    parts = by_id(ppm.lm_scores(df, block_bytes=1_000_000, piece=20))
    assert {i: parts[i].score for i in want} == pytest.approx(want)


def test_a_trie_is_a_distribution(rows):
    trie = whole_trie([r.text or "" for r in rows])
    context = [257, 257, ord("t"), ord("h"), ord("e")]
    grams = np.array([sum(s << 9 * i for i, s in enumerate([x, *reversed(context)])) for x in range(257)], dtype=np.uint64)
    assert (10 ** trie.log10(grams)).sum() == pytest.approx(1)


# -- all ----------------------------------------------------------------------------------------


def test_empty_tables(nothing):
    path = tokenizer("word_bpe_49k.json")
    each = [simhash.near_duplicates(nothing), simhash.one_of_each(nothing), quality.quality(nothing), quality.keep_clean(nothing), mixing.mix(nothing), token_counts.token_counts(nothing, tokenizer("byte_bpe_50k.json")), pii.pii_spans(nothing),
            substring_dedup.remove_repeated_words(nothing), suffix_dedup.remove_repeated_bytes(nothing), search.top_k(nothing, nothing["doc_id"] % 20 == 0), ppm.lm_scores(nothing), bpe_stream.bpe_round_trip(nothing, path)]
    assert [df.count() for df in each] == [0] * len(each)


@pytest.fixture(scope="session")
def hostile(spark):
    """Rows alike in id and text, an id on different texts, null ids by value, a text of a megabyte, and columns with the operators' own names."""
    long = " ".join(f"w{i % 7919}x{i % 17}" for i in range(130_000))
    rows = [(1, "one two three " * 9), (1, "one two three " * 9), (1, "another text altogether, with a@b.org"), (2, "one two three " * 9), (3, long), (None, "one two three " * 9), (None, None), (None, None), (4, ""), (5, "x"), (20, "three two one")]
    kinds = "fingerprint string, _row int, _id int, block int, text_hash int, size string, row string, source_key string, kept string, score string, h string, gram string, shard string, asked string, known string, pieces string, spans string"
    return spark.createDataFrame([(*r, "s", *[1 if " int" in k else "x" for k in kinds.split(", ")]) for r in rows], f"doc_id bigint, text string, source string, {kinds}").repartition(3)


def test_repeated_rows_and_null_ids_get_the_results_of_their_text(spark, hostile):
    """Every operator gives each row what the row alone would get by its text, whatever else the table holds."""
    texts = Counter((r.doc_id, r.text) for r in hostile.collect())
    by_text = {
        "near": (simhash.near_duplicates(hostile), lambda t: f"{plain_fingerprint(t):016x}", "fingerprint"),
        "quality": (quality.quality(hostile), lambda t: len(words(t)), "n_words"),
        "mix": (mixing.mix(hostile), lambda t: len(words(t)), "size"),
        "tokens": (token_counts.token_counts(hostile, tokenizer("byte_bpe_50k.json")), lambda t: len((t or "").encode()), "n_bytes"),
        "pii": (pii.pii_spans(hostile), lambda t: ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t)), "spans"),
        "substring": (substring_dedup.remove_repeated_words(hostile), lambda t: len(words(t)), "n_words"),
        "suffix": (suffix_dedup.remove_repeated_bytes(hostile), lambda t: len((t or "").encode()), "n_bytes"),
        "lm": (ppm.lm_scores(hostile), lambda t: len(words(t)) + 1, "n_tokens"),
        "bpe": (bpe_stream.bpe_round_trip(hostile, tokenizer("word_bpe_49k.json"), payload=False), lambda t: None, "doc_id"),
    }
    for name, (df, of, column) in by_text.items():
        got = Counter((r.doc_id, r[column]) if column != "doc_id" else (r.doc_id, None) for r in df.collect())
        want = Counter()
        for (i, t), n in texts.items():
            want[i, of(t)] += n
        assert got == want, name


def test_verdicts_of_hostile_rows(hostile):
    """Fingerprint classes, kept, taken, scores and hits of hostile rows are those of brute force."""
    rows = hostile.collect()
    known = [r for r in rows if r.doc_id is not None]
    classes_ = {}
    for r in rows:
        near = [o.doc_id for o in known if (plain_fingerprint(o.text) ^ plain_fingerprint(r.text)).bit_count() <= 3]
        classes_.setdefault((r.doc_id, plain_fingerprint(r.text)), min(near, default=None))
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.near_duplicates(hostile).collect()} == classes_
    assert {r.doc_id for r in quality.quality(hostile).collect() if r.kept} <= {3}
    mixed = mixing.mix(hostile).collect()
    # A document is taken as a whole, so the longest one decides how near the target the mix can come.
    assert all(r.taken in (0, r.size, 2 * r.size) for r in mixed) and abs(sum(r.taken for r in mixed) - mixed[0].target) <= max(r.size for r in mixed) / 2 + 10
    got = Counter((r.query_id, r["rank"], r.doc_id, r.score) for r in search.top_k(hostile, hostile["doc_id"] % 20 == 0, k=20).collect())
    assert got == Counter((20, i + 1, d, s) for i, (d, s) in enumerate(plain_search(rows, 20, lambda r: r.doc_id == 20)[0]))


def test_repeated_rows_are_one_document_to_the_substring_operators(hostile):
    words_, bytes_ = substring_dedup.remove_repeated_words(hostile).collect(), suffix_dedup.remove_repeated_bytes(hostile).collect()
    # The text of 27 words: first at id 1 (twice, alike), repeated at 2 and at the null id, where all of it goes.
    assert Counter((r.doc_id, r.n_removed) for r in words_ if r.n_words == 27) == {(1, 24): 2, (2, 27): 1, (None, 27): 1}
    assert Counter((r.doc_id, r.n_removed > 0, r.n_removed == r.n_bytes) for r in bytes_ if r.n_bytes == 126) == {(1, True, False): 2, (2, True, True): 1, (None, True, True): 1}


def test_one_of_each_keeps_clashing_columns(hostile):
    for how in ({}, {"similarity": 0.8}):
        kept = simhash.one_of_each(hostile, **how)
        assert kept.columns == hostile.columns
        texts = {"one two three " * 9: 1, "another text altogether, with a@b.org": 1, "x": 5, "three two one": 20}
        got = {(r.text or "")[:20]: r.doc_id for r in kept.collect() if (r.doc_id, len(r.text or "")) and r.doc_id != 3}
        assert got == {t[:20]: i for t, i in texts.items()} | {"": 4}


def test_null_ids_get_results(docs):
    each = [simhash.near_duplicates(docs), quality.quality(docs), token_counts.token_counts(docs, tokenizer("byte_bpe_50k.json")), pii.pii_spans(docs), substring_dedup.remove_repeated_words(docs), suffix_dedup.remove_repeated_bytes(docs), ppm.lm_scores(docs)]
    assert [df.filter("doc_id is null").count() for df in each] == [2] * len(each)


def test_near_dedup_joins_a_crowd_about_the_bound(spark):
    """Copies of one text, each edited elsewhere: few pairs reach the bound, and every one of them counts."""
    rng, texts = random.Random(4), {}
    base = [f"h{j}" for j in range(120)]
    for i in range(700):
        own = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            own[rng.randrange(120)] = f"e{rng.randint(0, 10**6)}"
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.one_of_each(df, similarity=0.8).collect()) == sorted(set(similar(texts).values()))
