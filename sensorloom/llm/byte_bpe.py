"""Byte-level BPE encoding and decoding with a given rank file.

Pre-tokenisation uses no regular expression. A table over all code points gives
each character a class (letter, number, space, line break, apostrophe, other)
and arrays of classes decide the pattern's piece boundaries: every rule of the
pattern is a run of one class with a fixed look at its neighbours. The transition
function of a character thus depends on its class and forgets the state before
the last two characters; composed over a prefix (the associative scan), it equals
the composition of the last three, so the scan comes down to comparing the class
array with itself, shifted. Pieces are slices of the text; their merges are
cached per worker, and the new pieces of a batch are merged together, one pair a
piece and round.

Defined results: null texts encode as empty ones (0 tokens). Offsets of the
tokens in the UTF-8 bytes are the prefix sums of the token lengths and are kept
by ``encode``. Repeated rows are encoded alike, an empty table gives an empty
result, columns other than doc_id and text are ignored. A text may be of any
length: arrays are linear in one batch of texts.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import as_text, bounded, longs, read, trimmed

LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
#: Characters held in arrays at once, and pieces cached per worker.
BATCH_CHARS, CACHE = 1 << 19, 150_000
#: Bytes beyond which a piece is merged by the heap; no pair.
LONG, NONE = 128, 1 << 40
# Fixed values of the pattern: contractions are an apostrophe and one of these.
SINGLE, DOUBLE = "stmd", ("re", "ve", "ll")
# Letters and numbers that Unicode 16.0 added, which the libraries know and older Python tables do not.
NEW_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5
 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point, from the Unicode general categories and White_Space."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in (r.split("-") for r in ranges.split()):
            table[int(first, 16) : int(last, 16) + 1] = kind
    return table


def boundaries(cp: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Start positions of the pieces of code points ``cp``; positions ``breaks`` separate texts.

    A start moves onto the blank before a run of letters, numbers or others; a
    white-space run gives up its last character when something follows it.
    """
    cls = class_table()[cp]
    cls[breaks] = BREAK
    change = np.empty(len(cls), bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    start = change.copy()
    solid = cls != SPACE
    blank_before = np.zeros(len(cls), bool)
    blank_before[1:] = (cp[:-1] == 32) & (cls[:-1] == SPACE)
    last = np.flatnonzero(~solid[:-1] & solid[1:] & (cls[1:] != BREAK))
    start[last] = True
    start[np.flatnonzero(change & solid & (cls != BREAK) & blank_before)] = False
    quote = np.flatnonzero((cp == 39) & change & (cls == OTHER) & ~blank_before)
    quote = quote[quote + 1 < len(cp)]
    if len(quote):
        tail = np.append(cp, [0, 0]).astype(np.int64)
        one, two = tail[quote + 1], tail[quote + 2]
        short = np.isin(one, [ord(c) for c in SINGLE])
        long = np.zeros(len(quote), bool)
        for a, b in DOUBLE:
            long |= (one == ord(a)) & (two == ord(b))
        for hit, width in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            start[hit + width] = True  # a break follows each text, so this stays inside
    start[breaks] = True
    return np.flatnonzero(start)


class Coder:
    """Ranks, merges and the piece cache of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.byte_rank = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, packed. Long pieces go to the heap; the rest share array rounds."""
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        for k, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[k] = r.to_bytes(4, "little")
            elif len(p) > LONG:
                out[k] = array("I", self.merge(p)).tobytes()
            else:
                rest.append(k)
        if not rest:
            return out
        sizes = np.fromiter((len(pieces[k]) for k in rest), np.int64, len(rest))
        token = self.byte_rank[np.frombuffer(b"".join([pieces[k] for k in rest]), np.uint8)]
        owner = np.repeat(np.arange(len(rest)), sizes)
        rank = np.full(len(token), NONE, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._pair_rank(token[inner], token[inner + 1])
        while len(token):
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(start, len(token)))
            least = np.minimum.reduceat(rank, start)
            done = least == NONE
            if done.any():
                over = np.repeat(done, size)
                ids = token[over].astype("<u4").tobytes()
                a = 0
                for k, n in zip(owner[start[done]].tolist(), size[done].tolist()):
                    out[rest[k]] = ids[a : a + 4 * n]
                    a += 4 * n
                token, owner, rank = token[~over], owner[~over], rank[~over]
                least, size = least[~done], size[~done]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]  # the leftmost of each piece
            token[hit] = rank[hit]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            token, owner, rank = token[keep], owner[keep], rank[keep]
            hit = place[hit]
            again = np.concatenate([hit, hit[hit > 0] - 1])
            last = len(token) - 1
            same = (again < last) & (owner[again] == owner[np.minimum(again + 1, last)])
            rank[again] = NONE
            again = again[same]
            rank[again] = self._pair_rank(token[again], token[again + 1])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Lowest-ranked pair first, the leftmost of equals; a heap over a linked list, n log n."""
        import heapq

        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        part, nxt, prv, alive = [piece[k : k + 1] for k in range(n)], [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            if not alive[k] or (m := nxt[k]) >= n or len(part[k]) + len(part[m]) != size:
                continue
            part[k] += part[m]
            alive[m] = False
            nxt[k] = nxt[m]
            if nxt[k] < n:
                prv[nxt[k]] = k
            for left in (prv[k], k):
                if left >= 0 and (right := nxt[left]) < n and (r := ranks.get(pair := part[left] + part[right])) is not None:
                    heapq.heappush(heap, (r, left, len(pair)))
        return [ranks[p] for p, ok in zip(part, alive) if ok]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        joined = "\0".join(texts) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        starts = boundaries(cp, breaks)
        ends_at = np.searchsorted(starts, breaks)
        s = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(s, s[1:] + [len(joined)])]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        # the breaks' own pieces stay in the list so that positions agree; they are skipped below
        new = list(set(pieces).difference(cache))
        cache.update(zip(new, self.merge_many([p.encode("utf-8", "surrogatepass") for p in new])))
        got = list(map(cache.__getitem__, pieces))
        out, a = [], 0
        for b in ends_at.tolist():
            out.append(b"".join(got[a:b]))
            a = b + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offsets of the tokens in the encoded text, the end included."""
        sizes = [len(self.bytes_of[k]) for k in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def slices_of(texts: list[str], budget: int = BATCH_CHARS) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > budget:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t) + 1
    if some:
        yield some


def encode(documents: DataFrame, ranks_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids and offsets, both binary."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        code = coder(ranks_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for pdf in batches:
            texts = pdf["text"].where(pdf["text"].notna(), "").tolist()
            at = 0
            for some in slices_of(texts):
                ids = code.encode_many(some)
                out = {"doc_id": longs(pdf["doc_id"].iloc[at : at + len(some)]), "n_tokens": [len(b) // 4 for b in ids],
                       "ids_sha256": [sha(b) for b in ids], "decoded_sha256": [sha(code.decode(b)) for b in ids]}
                if keep_ids:
                    out |= {"ids": ids, "offsets": [code.offsets(b).astype("<i8").tobytes() for b in ids]}
                at += len(some)
                yield pd.DataFrame(out)

    return bounded(documents).select(as_text("doc_id"), "text").mapInPandas(trimmed(run), schema + ", ids binary, offsets binary" * keep_ids)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), ranks_path or default_ranks())
