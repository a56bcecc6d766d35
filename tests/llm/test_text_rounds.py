"""Operators 2, 6, 8 and 10 against brute force on a fixture of edge cases, and on empty tables."""
import random

import numpy as np
import pytest

from fluxsieve.llm import bpe, lm_score, queries, substring, suffix
from fluxsieve.llm import common as C
from fluxsieve.llm.queries import vocabulary

from . import brute


def bag(rows):
    return sorted(rows, key=repr)


def test_substring(odd, odd_list, none):
    got = substring.remove_repeated(odd, window=13, carry=["doc_id", "batch"])
    assert got.columns == ["doc_id", "batch", "n_words", "n_removed", "kept_text"]
    want = brute.word_windows([(r[0], r[1]) for r in odd_list], 13)
    assert bag((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in got.collect()) == \
        bag((r[0], *w) for r, w in zip(odd_list, want))
    assert sum(w[1] for w in want) > 500
    assert substring.remove_repeated(none).count() == 0


def test_cover_reaches_every_shift():
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + d) % substring.PERIOD in substring.COVER and (j + d) % substring.PERIOD in substring.COVER
                       for d in range(substring.PERIOD))


@pytest.mark.parametrize("crowd,batch", [(256, 1 << 20), (2, 1 << 10)])
def test_suffix(odd, odd_list, none, crowd, batch):
    got = suffix.remove_repeated(odd, length=200, crowd=crowd, batch_bytes=batch)
    want = brute.byte_windows([r[1] for r in odd_list], 200)
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == \
        bag((r[0], *w) for r, w in zip(odd_list, want))
    assert suffix.remove_repeated(none).count() == 0


def passage_with_edges(n, seed):
    """Texts that share a passage of 230 bytes, with different bytes next to it."""
    rnd = random.Random(seed)
    say = lambda k: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    body = say(230)
    return [say(150) + body + say(150) for _ in range(n)]


def test_suffix_common_passage(frame):
    """Some batches hold many contexts of the passage's anchors, others few; some edges occur twice."""
    texts = passage_with_edges(560, 6)
    texts += [t[:300] + "#" for t in texts[:40]] + ["#" + t[170:] for t in texts[40:80]] + texts[80:100]
    got = suffix.remove_repeated(frame(list(enumerate(texts))), length=200)
    want = brute.byte_windows(texts, 200)
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == \
        bag((i, *w) for i, w in enumerate(want))


def test_suffix_common_passage_is_spread():
    """Holders of a common passage do not meet: not in a bucket of anchors, not in a shard."""
    n, length = 64, 200
    texts = [t.encode() for t in passage_with_edges(24 * n, 7)]
    batches = [texts[i::n] for i in range(n)]
    inbox = {}
    for src, own in enumerate(batches):
        for dest, _, _, data in suffix._send_anchors(own, n, src, length):
            inbox.setdefault(dest, []).append((src, *C.unpack(data, np.uint64, np.uint64, np.uint8)))
    most = max(np.unique(np.concatenate([g[1] for g in got]), return_counts=True)[1].max() for got in inbox.values())
    assert most < 16 * n
    replies = {}
    for bucket, got in sorted(inbox.items()):
        for dest, _, _, data in suffix._judge(got, bucket, suffix.CROWD):
            replies.setdefault(dest, []).append(C.unpack(data, np.uint8)[0])
    load = np.zeros(n)
    for src, own in enumerate(batches):
        for dest, _, _, data in suffix._send_pieces(suffix._Text(own, length), np.concatenate(replies[src]), length, n, src):
            load[dest] += len(data)
    assert load.max() < load.mean() + suffix.CROWD * (2 * length)     # an anchor that is not crowded stays together


def test_suffix_order():
    rnd = random.Random(1)
    for turn in range(120):
        pieces = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 8))]
        if turn % 3 == 0:
            pieces += [b"a" * rnd.randint(1, 40)] * 2 + [b"ab" * 20]
        text = b"".join(pieces)
        ends = np.repeat(np.cumsum([len(p) for p in pieces]), [len(p) for p in pieces]).astype(np.int64)
        order = suffix.sort_suffixes(text, ends, 10 ** 6)
        assert sorted(order.tolist()) == list(range(len(text)))
        assert [text[i:ends[i]] for i in order] == sorted(text[i:ends[i]] for i in range(len(text)))
        size = rnd.randint(8, 16)
        cut = [text[i:i + size] if ends[i] - i >= size else None for i in range(len(text))]
        want = [i for i, c in enumerate(cut) if c is not None and cut.count(c) > 1]
        assert suffix.repeated_positions(text, ends, size).tolist() == want


def test_suffix_whole_characters(frame):
    body = "é" * 101
    rows = [(1, "x" + body + "ö"), (2, "y" + body + "ö")]
    got = suffix.remove_repeated(frame(rows), length=201, whole_characters=True).collect()
    assert sorted(bytes(r.kept).decode() for r in got) == ["x", "y"]


def test_bpe(odd, odd_list, none):
    from tokenizers import Tokenizer
    path = vocabulary()
    whole = Tokenizer.from_file(path)
    got = bpe.encode_documents(odd, path, batch_bytes=1 << 12)
    want = []
    for r in odd_list:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), whole.decode(ids, skip_special_tokens=False).encode()))
    assert bag((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == bag(want)
    digests = bpe.encode_digests(odd, path).collect()
    assert bag((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == \
        bag((i, n, brute.sha(a), brute.sha(b)) for i, n, a, b in want)
    assert bpe.encode_documents(none, path).count() == 0


def test_bpe_query_hashes_the_operators_output(spark, monkeypatch):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    want = bag(map(tuple, bpe.encode_digests(docs, vocabulary()).collect()))
    monkeypatch.delattr(bpe, "encode_digests")
    got = queries.op6_bpe_chunk_reuse(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bag(map(tuple, got.collect())) == want


def test_bpe_joins_at_any_cut():
    c = bpe.codec(vocabulary())
    rnd = random.Random(2)
    bits = ["a", "b", "'s", "'ll", "'", "l", " ", "  ", "\n", " \n", "é", "ß", "日本", "🙂", "1", "23", "!", "\t", " The", "ing", "\u00a0", "\u3000"]
    for _ in range(1500):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60)))
        parts, at = [], 0
        while at < len(text):
            k = rnd.randint(1, 20)
            parts.append(text[at:at + k].encode())
            at += k
        got = np.concatenate(bpe.join(parts, [c.encode(p) for p in parts], c)).tolist()
        assert got == c.whole.encode(text, add_special_tokens=False).ids


def test_chunks_are_shared():
    rnd = random.Random(3)
    body = " ".join(str(rnd.random()) for _ in range(2000)).encode()
    a, b = bpe.chunks(b"one start " + body), bpe.chunks(b"quite another start, longer " + body)
    assert b"".join(a) == b"one start " + body
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_lm(odd, odd_list, none, spark):
    good = {r[0] for r in odd_list if r[0] is not None and r[0] % 2 == 0}
    targets = spark.createDataFrame([(i,) for i in [*good, None, 2]], "doc_id long")
    got = lm_score.score(odd, targets, least_count=4, batch_bytes=1 << 12).collect()
    want = brute.lm_scores([(r[0], r[1]) for r in odd_list], good, 4)
    show = lambda i, n, s: (i, n, None if s is None else round(s, 8))
    assert bag(show(r.doc_id, r.n_tokens, r.score) for r in got) == bag(show(r[0], n, s) for r, (n, s) in zip(odd_list, want))
    assert lm_score.score(none, targets).count() == 0
    assert lm_score.score(odd, targets.limit(0)).count() == len(odd_list)
