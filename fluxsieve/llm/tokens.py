"""Token ids of many texts at once (used by operators 12 and 13).

The byte-level pattern keeps the last character of a run of white space for what follows, which it
says with a look-ahead that makes matching slow.  Texts are cut at just those places beforehand, so
the same pattern without it gives the same ids; runs of 512 characters without a break go through
the ``tokenizers`` library, whose merges are not quadratic in them.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bpe

#: White space as the pattern sees it (Python's own class has four control characters more).
_SPACE = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_SPACE}][{_SPACE}]")
_CUT = re.compile(f"(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}])")
#: Bytes without a break from which merges take another way.
LONG = 512
_AHEAD = r"\s+(?!\S)|"


class ByteTokens:
    """A byte-level BPE vocabulary (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.codec = bpe.codec(path)
        ranked = self.codec.ranked
        self.cuts = ranked._pat_str.endswith("|" + _AHEAD + r"\s+")
        self.ranked = tiktoken.Encoding("cut", pat_str=ranked._pat_str.replace(_AHEAD, ""), special_tokens={},
                                        mergeable_ranks=ranked._mergeable_ranks) if self.cuts else ranked
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True      # their strings in a text are ordinary text
        self.bytes_of, self.length_of = self.codec.bytes_of, self.codec.length_of
        self.special = [s.decode() for s in self.codec.special]

    def plain(self, text: str) -> list[int]:
        """Ids of a text, all of it ordinary text."""
        if bpe._LONG.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if self.cuts and _RUN.search(text):
            return [i for part in _CUT.split(text) for i in self.ranked.encode_ordinary(part)]
        return self.ranked.encode_ordinary(text)

    def plain_all(self, texts: list[str], odd: np.ndarray, lead: str = "") -> list[list[int]]:
        """Ids of ``lead`` and each text; ``odd`` as :func:`odd_texts` says, the others need no closer look."""
        easy = self.ranked.encode_ordinary
        return [self.plain(lead + t) if o else easy(lead + t) for t, o in zip(texts, odd.tolist())]

    def encode_all(self, texts: list[str], odd: np.ndarray) -> list[list[int]]:
        """:meth:`encode` of each text."""
        easy, special = self.ranked.encode_ordinary, self.special
        return [self.encode(t) if o or any(s in t for s in special) else easy(t) for t, o in zip(texts, odd.tolist())]

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them without special tokens added: strings of special tokens in the
        text become their ids."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        out: list[int] = []
        for body, special in self.codec.segments(text.encode()):
            out += self.plain(body.decode())
            if special is not None:
                out.append(special)
        return out


class PieceTokens:
    """A sentencepiece model with byte fallback, which puts a space before every text itself."""

    def __init__(self, path: str):
        import sentencepiece
        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes_of = [b"" if m.is_control(i) or m.is_unknown(i) else bytes([int(p[3:5], 16)]) if m.is_byte(i)
                         else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)

    def plain(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    """One per worker process."""
    return ByteTokens(path)


@functools.lru_cache(maxsize=2)
def piece_tokens(path: str) -> PieceTokens:
    """One per worker process."""
    return PieceTokens(path)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and the last one ends."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw else np.zeros(0, np.uint8)), at - at[0]


def odd_texts(column: pa.Array) -> np.ndarray:
    """Texts (a binary column) that may hold white space side by side, at their begin or beyond ASCII, or ``LONG``
    bytes without a break: what the plain pattern or its merges do not suit.  May say so of others."""
    raw, at = _bytes(column)
    out = np.zeros(len(at) - 1, bool)
    if not len(raw):
        return out
    text_of = lambda p: np.searchsorted(at, p, "right") - 1
    begins = at[:-1][at[:-1] < at[1:]]
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    out[text_of(begins[space[begins]])] = True
    out[text_of(np.flatnonzero(space[1:] & space[:-1]))] = True
    wide = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xE3))
    first, then = raw[wide], raw[wide + 1]
    out[text_of(wide[((first == 0xC2) & ((then == 0x85) | (then == 0xA0))) | ((first == 0xE1) & (then == 0x9A))
                     | ((first == 0xE2) & (then <= 0x81)) | ((first == 0xE3) & (then == 0x80))])] = True
    space[begins] = True
    breaks = np.flatnonzero(space)
    out[text_of(breaks[np.diff(np.append(breaks, len(raw))) >= LONG])] = True
    return out


def slices(batches, text: str, size: int):
    """Arrow batches cut into runs of rows with about ``size`` bytes of the binary column ``text``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // size
        cuts = (np.flatnonzero(np.diff(part)) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
            if j > i:
                yield batch.slice(i, j - i)
