"""BPE encoding and decoding with content-defined chunk reuse (operator 6).

Texts are encoded exactly as the ``tokenizers`` library does with a byte-level BPE file and
``add_special_tokens=False`` (strings of special tokens inside a text become their ids), and
the ids are decoded again by the vocabulary's byte table.

1. Texts are cut into chunks where a rolling hash of the last 16 bytes says so, so equal
   passages are cut alike wherever they stand.  Batches send the digests of their distinct
   chunks; buckets choose one batch for each chunk that several hold.
2. That batch encodes the chunk once and publishes its ids; the bucket delivers them to every
   batch that holds it.  A chunk held by one batch is encoded once there.
3. Documents are assembled from chunk ids.  A join of two chunks is repaired by re-encoding the
   text around it, from the last certain token boundary of the left chunk to the first one of
   the right chunk; the repair widens until it agrees with the chunks' own tokens on both
   sides.  A place between a printable ASCII character and a space is such a boundary for
   every text around it: no alternative of the pre-tokenizer's pattern runs on into a space.

Equal texts come out exactly equal to encoding them whole.  Encoding within a chunk uses the
same vocabulary as merge ranks, read from the JSON file itself; runs of 512 or more characters
without a break go through the ``tokenizers`` library, whose merges are not quadratic in them.

Defined results: a null or empty text has no ids and decodes to the empty string.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..session import ship_package
from . import common as C

#: Bytes the rolling hash sees, mean and least chunk size in bytes.
ROLL, MEAN, LEAST = 16, 1024, 256

_TABLE = C.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_LONG = re.compile(r"\S{512}|\s{512}")
_EDGE = re.compile(rb"[!-~] ")


class Codec:
    """Encoder and decoder of one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        plain = _byte_of_char()
        table = {i: bytes(plain[c] for c in s) for s, i in spec["model"]["vocab"].items() if s.encode() not in self.special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                        mergeable_ranks={b: i for i, b in table.items()})
        table |= {i: s for s, i in self.special.items()}
        self.bytes_of = [table.get(i, b"") for i in range(max(table) + 1)]
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.split = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def encode(self, raw: bytes) -> np.ndarray:
        """Ids of a text without special tokens."""
        text = raw.decode("utf-8", "replace")
        if _LONG.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked.encode_ordinary(text), np.uint32)

    def segments(self, raw: bytes):
        """``(text, special id or None)``: the text split at special tokens' strings."""
        at, out = 0, []
        for m in self.split.finditer(raw) if self.split else ():
            out.append((raw[at:m.start()], self.special[m.group()]))
            at = m.end()
        out.append((raw[at:], None))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()


def _byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 is itself,
    the other bytes follow from code point 256 in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process."""
    return Codec(path)


# ------------------------------------------------------------------ chunks

def chunks(raw: bytes, mean: int = MEAN, least: int = LEAST) -> list[bytes]:
    """Content-defined chunks (never inside a UTF-8 character)."""
    if len(raw) <= least + ROLL:
        return [raw] if raw else []
    x = np.frombuffer(raw, np.uint8)
    h, b, span = _TABLE[x], 0xC2B2AE3D27D4EB4F, 1
    while span < ROLL:
        h = h[:-span] * np.uint64(b) + h[span:]
        b, span = (b * b) & 0xFFFFFFFFFFFFFFFF, span * 2
    at = np.flatnonzero(C.mix(h) % np.uint64(mean) == 0) + ROLL      # cut after the 16 bytes
    at = at[at < len(raw)]
    at = at[(x[at] & 0xC0) != 0x80]
    out, last = [], 0
    for p in at.tolist():
        if p - last >= least:
            out.append(raw[last:p])
            last = p
    out.append(raw[last:])
    return out


def _first_edge(chunk: bytes) -> int:
    m = _EDGE.search(chunk)
    return m.start() + 1 if m else -1


def _last_edge(chunk: bytes) -> int:
    at = chunk.rfind(b" ")
    while at > 0 and not 33 <= chunk[at - 1] <= 126:
        at = chunk.rfind(b" ", 0, at)
    return at if at > 0 else -1


def join(parts: list[bytes], ids: list[np.ndarray], c: Codec) -> list[np.ndarray]:
    """Ids of the chunks' concatenation, re-encoding only around the joins."""
    if len(parts) == 1:
        return list(ids)
    out, glue, final = [], b"", len(parts) - 1
    for k, (part, own) in enumerate(zip(parts, ids)):
        lo = 0 if k == 0 else _first_edge(part)
        hi = len(part) if k == final else _last_edge(part)
        if lo < 0 or hi < lo:
            glue += part
            continue
        ends = np.concatenate([[0], np.cumsum(c.length_of[own])])
        i, j = np.searchsorted(ends, [lo, hi])
        if ends[i] != lo or ends[j] != hi:        # not a token boundary here: widen the repair over the chunk
            glue += part
            continue
        glue += part[:lo]
        if glue:
            out.append(c.encode(glue))
        out.append(own[i:j])
        glue = part[hi:]
    if glue:
        out.append(c.encode(glue))
    return out


# ------------------------------------------------------------------ the operator

class _Chunked:
    """The documents of a batch as segments of chunks, with the distinct chunks in digest order."""

    def __init__(self, texts, c: Codec):
        self.docs, seen = [], {}
        for t in texts:
            segs = []
            for body, special in c.segments(t):
                parts = chunks(body)
                segs.append(([seen.setdefault(p, len(seen)) for p in parts], special))
            self.docs.append(segs)
        self.parts = list(seen)
        raw = b"".join(xxhash.xxh3_128_digest(p) for p in self.parts)
        d = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
        self.order = np.lexsort((d[:, 1], d[:, 0]))
        self.a, self.b = d[self.order, 0], d[self.order, 1]


#: What a bucket answers for a batch's chunk: nobody else has it; another batch encodes it; this one does.
OWN, OTHERS, PUBLISH = 0, 1, 2


def _choose(got, bucket):
    a, b = (np.concatenate([g[i] for g in got]) for i in (1, 2))
    order = np.lexsort((b, a))                    # stable: the first sender is the one that encodes
    first = C.run_starts(a[order], b[order])
    size = np.diff(np.append(first, len(a)))
    flag = np.repeat(np.where(size > 1, OTHERS, OWN), size)
    flag[first[size > 1]] = PUBLISH
    out = np.empty(len(a), np.uint8)
    out[order] = flag
    at = np.cumsum([0, *[len(g[1]) for g in got]])
    return [(g[0], bucket, 1, C.pack(out[at[i]:at[i + 1]])) for i, g in enumerate(got)]


def _publish(x: _Chunked, flags, c: Codec, n, src):
    """Ids of the chunks this batch encodes for all, and requests for every shared chunk it holds."""
    out = []
    for bucket, i, j in C.by_bucket(x.a, n):
        s = np.arange(i, j)
        want = s[flags[s] != OWN]
        if not len(want):
            continue
        mine = s[flags[s] == PUBLISH]
        ids = [c.encode(x.parts[x.order[k]]) for k in mine.tolist()]
        sizes = np.array([len(i) for i in ids], np.int64)
        out.append((bucket, src, 2, C.pack(x.a[want], x.b[want], x.a[mine], x.b[mine], C.small(sizes),
                                           C.small(np.concatenate(ids) if ids else np.zeros(0, np.uint32)))))
    return out


def _deliver(got, bucket):
    """To every requesting batch: the ids of the chunks it asked for, in its order."""
    ids_of = {}
    for _, _, _, ma, mb, sizes, ids in got:
        at = np.concatenate([[0], np.cumsum(sizes)])
        for k, key in enumerate(zip(ma.tolist(), mb.tolist())):
            ids_of[key] = ids[at[k]:at[k + 1]]
    out = []
    for src, wa, wb, *_ in got:
        own = [ids_of[k] for k in zip(wa.tolist(), wb.tolist())]
        out.append((src, bucket, 2, C.pack(C.small(np.array([len(i) for i in own], np.int64)),
                                           C.small(np.concatenate(own) if own else np.zeros(0, np.uint32)))))
    return out


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry=(),
                     batch_bytes: int = C.BATCH_BYTES) -> DataFrame:
    """Carried columns (default the id) with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit
    integers) and ``decoded`` (UTF-8).  ``path`` names the vocabulary file on every worker."""
    return _encoded(docs, path, id_col, text_col, carry, batch_bytes,
                    "ids binary, decoded binary", lambda ids, text: (ids, text), pa.binary())


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry=(),
                   batch_bytes: int = C.BATCH_BYTES) -> DataFrame:
    """As :func:`encode_documents`, with the SHA-256 of ids and decoded text in their place, so that
    wide tables of ids need not be written to compare or audit them."""
    return _encoded(docs, path, id_col, text_col, carry, batch_bytes, "ids_sha256 string, decoded_sha256 string",
                    lambda ids, text: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()), pa.string())


def _encoded(docs, path, id_col, text_col, carry, batch_bytes, fields, show, kind):
    ship_package(docs.sparkSession)
    n = C.group_count(docs, text_col, batch_bytes)
    left = C.batched(docs, n, id_col, text_col, carry)

    def ask(key, table):
        _, _, texts = C.rows_in_order(table)
        x = _Chunked(texts, codec(path))
        return C.messages(C.ask(x.a, n, key[0].as_py(), 1, x.b))

    def choose(key, table):
        return C.messages(_choose([(s, *C.unpack(m, np.uint64, np.uint64)) for _, s, m in C.inbox(table)], key[0].as_py()))

    def publish(key, docs_t, answers):
        _, _, texts = C.rows_in_order(docs_t)
        c = codec(path)
        return C.messages(_publish(_Chunked(texts, c), C.replies(answers, 1, np.uint8), c, n, key[0].as_py()))

    def deliver(key, table):
        got = [(s, *C.unpack(m, np.uint64, np.uint64, np.uint64, np.uint64, None, None)) for _, s, m in C.inbox(table)]
        return C.messages(_deliver([(*g[:5], C.wide(g[5]), C.wide(g[6])) for g in got], key[0].as_py()))

    def assemble(key, docs_t, answers):
        table, _, texts = C.rows_in_order(docs_t)
        c = codec(path)
        x = _Chunked(texts, c)
        flags = C.replies(answers, 1, np.uint8)
        ids: list = [None] * len(x.parts)
        got = [C.unpack(m, None, None) for _, _, m in C.inbox(answers, 2)]
        sizes = np.concatenate([np.zeros(0, np.int64), *[C.wide(g[0]) for g in got]])
        flat = np.concatenate([np.zeros(0, np.uint32), *[C.wide(g[1]).astype(np.uint32) for g in got]])
        at = np.concatenate([[0], np.cumsum(sizes)])
        for k, which in enumerate(x.order[flags != OWN].tolist()):
            ids[which] = flat[at[k]:at[k + 1]]
        for which in x.order[flags == OWN].tolist():
            ids[which] = c.encode(x.parts[which])
        counts, one, two = [], [], []
        for segs in x.docs:
            out = []
            for parts, special in segs:
                if parts:
                    out += join([x.parts[p] for p in parts], [ids[p] for p in parts], c)
                if special is not None:
                    out.append(np.array([special], np.uint32))
            doc = np.concatenate(out) if out else np.zeros(0, np.uint32)
            counts.append(len(doc))
            a, b = show(doc.astype("<u4").tobytes(), c.decode(doc))
            one.append(a)
            two.append(b)
        names = [f.split()[0] for f in fields.split(", ")]
        return C.result(table, n_tokens=pa.array(counts, pa.int64()), **{names[0]: pa.array(one, kind), names[1]: pa.array(two, kind)})

    flags = left.groupBy("batch").applyInArrow(ask, C.MSG).groupBy("dest").applyInArrow(choose, C.MSG)
    sent = left.groupBy("batch").cogroup(flags.groupBy("dest")).applyInArrow(publish, C.MSG)
    ids = sent.groupBy("dest").applyInArrow(deliver, C.MSG)
    out = left.groupBy("batch").cogroup(flags.unionAll(ids).groupBy("dest")).applyInArrow(
        assemble, C.out_schema(left, f"n_tokens bigint, {fields}"))
    return C.with_carried(out, carry, id_col)
