"""Operators 11 to 13 against brute force on odd fixtures, on many small shards, and on empty tables."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxsieve.llm import align, prefix_trie, queries, token_files, tokens
from fluxsieve.llm.queries import pieces, vocabulary

from .conftest import CLASHING

TABLE = "conv_id long, turn long, role string, text string"


# ------------------------------------------------------------------ 11

def conversations():
    """Odd conversations: shared beginnings, copies, null and empty values, ties, a long one, missing ids."""
    rnd = random.Random(3)
    rows, first = [], [("user", f"say {k}") for k in range(3)]
    for c in range(140):
        n = rnd.choice([1, 1, 2, 3, 5, 9])
        turns = [rnd.choice(first) if rnd.random() < 0.7 else (rnd.choice(["user", "assistant", None]), rnd.choice(["é" * 3, "", None, "x y"])) for _ in range(n)]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(200 + c, k, "user", f"same {k}") for c in range(60) for k in range(4)]
    rows += [(300, None, "user", "null turn"), (300, 0, "user", "b"), (300, 0, "assistant", "a"), (300, 0, "user", "b"), (None, 0, "user", "nobody")]
    rows += [(400, k, "user", "q" * (k % 7)) for k in range(150)] + [(401, k, "user", "q" * (k % 7)) for k in range(149)]
    return rows + [(9950 + c, 0, "user", "alone") for c in range(12)]


def ordered(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), x))
    return {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}


def nodes(seqs):
    """Every distinct beginning with its members, children, leaves and savings."""
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_trie(spark, shards, monkeypatch):
    monkeypatch.setattr(prefix_trie, "NEIGHBOURS", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    df = spark.createDataFrame(conversations(), TABLE).select("*", *[F.lit("x").alias(c) for c in CLASHING])
    got = prefix_trie.trie(prefix_trie.sequences(df), least_shards=shards, width=4)
    assert found(got) == nodes(ordered(conversations()))


def test_trie_rebuilt(spark):
    rows = conversations()
    seqs = ordered(rows)
    want = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = seqs.get(c - c % 100, [])[:h] + own[h:]
    assert any(not t for t in want.values())                        # a conversation without turns
    got = prefix_trie.trie(queries.rebuilt(prefix_trie.sequences(spark.createDataFrame(rows, TABLE))))
    assert found(got) == nodes(want)


def test_trie_empty(spark):
    none = spark.createDataFrame([], TABLE)
    assert prefix_trie.trie(queries.rebuilt(prefix_trie.sequences(none))).count() == 0
    assert prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([(None, 0, "user", "a")], TABLE))).count() == 0


def test_trie_hot_sequence_is_spread(spark):
    """Two thirds of the conversations are one sequence; no shard holds twice its share."""
    rows = [(c, k, "user", f"{k if c % 3 else c}") for c in range(3000) for k in range(3)]
    n = 16
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, TABLE))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    sizes = seqs.select("conv_id", key.alias("key")).repartitionByRange(n, "key", "conv_id").groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * 3000 / n
    assert found(prefix_trie.trie(seqs, least_shards=n)) == nodes(ordered(rows))


# ------------------------------------------------------------------ 12

def library(special_as_text=False):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = special_as_text
    return t


def test_code_is_optimal_within_its_limit():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 40, 300):
        counts = rnd.integers(1, 1 << 30, n) >> rnd.integers(0, 28, n)
        counts = np.maximum(counts, 1)
        limit = max(4, (n - 1).bit_length() + 1)
        bits = token_files.code_lengths(counts, limit)
        assert bits.max() <= limit and (2.0 ** -bits).sum() <= 1 + 1e-12
        free = token_files.code_lengths(counts, 40)
        import heapq
        heap, total = sorted(int(c) for c in counts), 0
        while len(heap) > 1:                                          # plain Huffman: the sum of all merges
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            total += a + b
            heapq.heappush(heap, a + b)
        assert n == 1 or int((free * counts).sum()) == total
    assert token_files.code_lengths(np.array([1] * 7 + [10 ** 9]), 3).tolist() == [3] * 8
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, np.int64), 3)


@given(st.lists(st.integers(0, 70000), min_size=1, max_size=2000))
@settings(max_examples=40, deadline=None)
def test_blocks_decode_alone(ids):
    ids = np.array(ids, np.int64)
    seen, n = np.unique(ids, return_counts=True)
    limit = token_files.limit_for(len(seen))
    code = token_files.Code(seen, token_files.code_lengths(n, limit), limit)
    cut = len(ids) // 3
    blocks = [(len(p), *code.pack(p)) for p in (ids[:cut], ids[cut:]) if len(p)]
    assert (code.unpack(blocks) == ids).all()
    assert (code.unpack(blocks[-1:]) == ids[cut if len(blocks) > 1 else 0:]).all()


def test_token_files(spark, odd, odd_list, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 700)                    # the longest text fills many blocks
    lib = library()
    rows = [(r[0], [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in odd_list]
    token_files.write(odd, str(tmp_path / "a"), vocabulary())
    got = token_files.read(spark, str(tmp_path / "a")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, list(np.frombuffer(r.ids, "<u4"))) for r in got)) == \
        sorted((i is None, i or 0, ids) for i, ids in rows)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    keys = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert spark.read.parquet(str(tmp_path / "a" / "blocks")).filter("pieces > 1").count() > 10
    token_files.write(none, str(tmp_path / "b"), vocabulary())
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


SPACES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "The", "é", "日本", "'s", "12", "!?", "<|endoftext|>", "▁", "\x1c", "\x85", "　",
                                   " ", "q" * 520, ".", " x", "\r\n", "<s>"]), max_size=12).map("".join)


@given(SPACES)
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(text):
    t = tokens.byte_tokens(vocabulary())
    assert t.encode(text) == library_once(False).encode(text, add_special_tokens=False).ids
    assert t.plain(" " + text) == library_once(True).encode(" " + text, add_special_tokens=False).ids


def library_once(special_as_text, made={}):
    if special_as_text not in made:
        made[special_as_text] = library(special_as_text)
    return made[special_as_text]


# ------------------------------------------------------------------ 13

def plain_alignment(text):
    """``(a, b, groups)`` of one text by sets of byte ends; groups are ``(A ids, B ids)``."""
    import sentencepiece
    lib = library_once(True)
    model = plain_alignment.__dict__.setdefault("model", sentencepiece.SentencePieceProcessor(model_file=pieces()))
    if not text:
        return [], [], []
    a, b = lib.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    size_a = [len(tokens.byte_tokens(vocabulary()).bytes_of[i]) for i in a]
    spelt = b"".join(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(model.id_to_piece, b))
    if spelt != (" " + text).encode():
        return [], [], []
    size_b = [1 if len(p) == 6 and p.startswith("<0x") else len(p.replace("▁", " ").encode()) for p in map(model.id_to_piece, b)]
    ea, eb = np.cumsum(size_a).tolist(), np.cumsum(size_b).tolist()
    groups, last = [], 0
    for cut in sorted(set(ea) & set(eb)):
        groups.append(([i for i, e in zip(a, ea) if last < e <= cut], [i for i, e in zip(b, eb) if last < e <= cut]))
        last = cut
    return a, b, groups


def plain_counts(texts):
    """Rows of the ``op13`` query."""
    every = [plain_alignment(t) for t in texts]
    linked = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, _, g in every]
    held = Counter(p for c in linked for p in c)
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (a, b, g), c in zip(every, linked):
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((len(a), len(b), len(g), sum(c.values()), sum(n for p, n in c.items() if held[p] == most[p[0]]),
                    sum(n * held[p] for p, n in c.items()), spelt))
    return out


def odd_texts(odd_list):
    rnd = random.Random(8)
    bits = ["naïve", "日本語", "xyzzy", "https://a.b/c?d=1", "\U0001f600", "é", "'ll", "\n\n", "▁", "  ", "<0x0A>", "</s>", "<|endoftext|>", "12345"]
    return [r[1] for r in odd_list if not r[1] or len(r[1]) < 5000] + [" ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(60)]


@pytest.mark.parametrize("lane,block", [(512, 1 << 20), (4, 2000)])
def test_alignment(frame, odd_list, none, lane, block, monkeypatch):
    monkeypatch.setattr(align, "LANE", lane)
    monkeypatch.setattr(align, "EXPAND", 64 * lane)
    texts = odd_texts(odd_list)
    docs = frame([(i, t) for i, t in enumerate(texts)])
    got = align.with_counts(align.alignments(docs, vocabulary(), pieces(), carry=["doc_id", "batch"], block_bytes=block, run_bytes=block // 2))
    assert got.columns == ["doc", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    want = plain_counts(texts)
    rows = {r.doc.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.collect()}
    assert rows == dict(enumerate(want))
    assert sum(w[3] for w in want) > 5000 and sum(not w[0] for w in want) > 3
    assert align.with_counts(align.alignments(none, vocabulary(), pieces())).count() == 0


@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=60), min_size=1, max_size=6), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_lockstep(docs, rnd):
    """Strips hold every pair of a group once, for any two partitions of the same bytes, long runs without a cut included."""
    side = []
    for sizes in docs:
        total, other = sum(sizes), []
        while total:
            other.append(min(total, rnd.randint(1, 5)))
            total -= other[-1]
        side.append(other)
    ea, eb = np.cumsum(np.concatenate(docs)), np.cumsum(np.concatenate(side))
    first = np.cumsum([0, *[len(d) for d in docs]])[:-1]
    old, align.LANE = align.LANE, 7
    try:
        ca, cb, of_a, of_b = align.lockstep(ea, eb, first)
    finally:
        align.LANE = old
    pairs = Counter()
    for t, lo, hi in zip(*of_a):
        pairs.update((int(t), int(p)) for p in range(lo, hi + 1))
    for t, lo, hi in zip(*of_b):
        pairs.update((int(p), int(t)) for p in range(lo, hi + 1))
    want, a0, b0 = Counter(), 0, 0
    for x, y in zip(ca.tolist(), cb.tolist()):
        want.update((i, j) for i in range(a0, x + 1) for j in range(b0, y + 1))
        a0, b0 = x + 1, y + 1
    assert pairs == want and a0 == len(ea) and b0 == len(eb)
    assert ea[ca].tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))


def test_queries(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    lib, start = library(), 0
    want = {}
    for i in sorted(docs):
        ids = np.array([*lib.encode(docs[i] or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = queries.op12_token_files(spark, sf_small)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    some = plain_counts([docs[i] for i in sorted(docs)])
    got = queries.op13_lockstep_alignment(spark, sf_small)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == \
        {i: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for i, w in zip(sorted(docs), some)}
