"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are one token. ``proven_tokens`` proves offline, for
every string of the vocabulary, whether it does encode alone as one token: it is
text, pre-tokenisation leaves it whole, and its merges, in their order, end in one
token (a vocabulary string need not be reachable by them). Counting then only
looks pre-tokens up in that proven set; what is not there has two tokens or more,
and only that is merged, once a worker for each distinct string.

Pre-tokens are slices found by comparing class arrays (``byte_bpe.boundaries``).
Added tokens of the file that occur in a text count one each and part it.

Defined results: null texts count as empty ones (0 bytes, 0 tokens). Repeated rows
are counted alike, an empty table gives an empty result, columns other than doc_id
and text are ignored. Texts and pre-tokens may be of any length: a pre-token of n
bytes merges in n log n steps.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import boundaries, slices_of
from .common import bounded, read, trimmed

LIMIT = 1024
#: Distinct merged pre-tokens that a worker remembers, and the longest of them in characters.
CACHE, CACHED_CHARS = 200_000, 256


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in vocabulary files: itself where it prints, else the next free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Strings, merges and added tokens of one byte-level file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.added = spec["model"], [t["content"] for t in spec["added_tokens"]]
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError(f"{path}: only plain byte-level BPE files are counted")
        self.ids, code = model["vocab"], byte_alphabet()
        self.strings = [bytes(map(code.__getitem__, s)) if all(c in code for c in s) else b"" for s in self.ids]
        self.byte_id = [0] * 256
        for c, b in code.items():
            self.byte_id[b] = self.ids[c]
        # (left id, right id) -> (order of the merge, merged id)
        self.pairs = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[self.ids[a], self.ids[b]] = k, self.ids[a + b]
        self.parting = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def merged(self, piece: bytes) -> int:
        """Tokens of a pre-token: the earliest merge first, the leftmost of equals, over a linked list."""
        n, pairs = len(piece), self.pairs
        token, nxt, prv = [self.byte_id[b] for b in piece], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(hit[0], k, token[k], token[k + 1]) for k in range(n - 1) if (hit := pairs.get((token[k], token[k + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            m = nxt[k]
            if token[k] != a or m >= n or token[m] != b:
                continue  # one side has gone into another merge
            token[k], token[m], nxt[k] = pairs[a, b][1], -1, nxt[m]
            left -= 1
            if nxt[k] < n:
                prv[nxt[k]] = k
            for at in (prv[k], k):
                if at >= 0 and nxt[at] < n and (hit := pairs.get(pair := (token[at], token[nxt[at]]))):
                    heapq.heappush(heap, (hit[0], at, *pair))
        return left

    def parts(self, text: str) -> list[str]:
        """The text between added tokens."""
        return self.parting.split(text) if self.parting else [text]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces_of(parts: list[str]) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of texts in a row; each text is followed by one separator, at the places returned."""
    joined = "\0".join(parts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.cumsum(np.fromiter((len(t) + 1 for t in parts), np.int64, len(parts))) - 1
    starts = boundaries(cp, breaks)
    s = starts.tolist()
    return [joined[a:b] for a, b in zip(s, s[1:] + [len(joined)])], np.searchsorted(starts, breaks)


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return ""


def proven_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(token): the strings of the vocabulary that encode alone as one token."""

    def run(batches):
        vocab = vocabulary(path)
        for b in batches:
            texts = [_decoded(vocab.strings[k]) for k in b["id"].to_pylist()]
            texts = [t for t in texts if t and vocab.parts(t) == [t]]
            alone = np.diff(np.r_[-1, pieces_of(texts)[1]]) == 2 if texts else []  # the piece and its separator
            found = [t for t, one in zip(texts, alone) if one and vocab.merged(t.encode()) == 1]
            yield pa.RecordBatch.from_pydict({"token": pa.array(found, pa.string())})

    return spark.range(0, len(vocabulary(path).strings), numPartitions=spark.sparkContext.defaultParallelism).mapInArrow(run, "token string")


class Sizes(dict):
    """Tokens of each pre-token: proven ones are there from the start, others are merged at first sight."""

    def __init__(self, proven, vocab: Vocabulary):
        super().__init__(proven)
        self.proven, self.vocab = proven, vocab

    def __missing__(self, piece: str) -> int:
        n = self.vocab.merged(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= CACHED_CHARS:
            if len(self) - len(self.proven) >= CACHE:
                self.clear()
                self.update(self.proven)
            self[piece] = n
        return n

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and how many of them are whole pre-tokens or added tokens."""
        parts = [self.vocab.parts(t) for t in texts]
        pieces, stops = pieces_of([p for ps in parts for p in ps])
        size = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        size[stops] = 0
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        last = stops[np.cumsum(many) - 1]
        total = lambda x: np.diff(np.r_[0, np.cumsum(x)[last]]) + many - 1
        return total(size), total(size == 1)


def count(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_whole (tokens counted without a merge)."""
    # at most as many strings as the vocabulary has
    proven = dict.fromkeys((r.token for r in proven_tokens(documents.sparkSession, path).collect()), 1)

    def run(batches):
        sizes = Sizes(proven, vocabulary(path))
        for b in batches:
            text = pc.fill_null(b["text"], "")
            got = [sizes.of(some) for some in slices_of(text.to_pylist())]
            n, whole = (pa.array(np.concatenate(x), pa.int64()) for x in zip(*got)) if got else (pa.array([], pa.int64()),) * 2
            n_bytes = pc.binary_length(text.cast(pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), n_bytes, n, whole], ["doc_id", "n_bytes", "n_tokens", "n_whole"])

    d = bounded(documents).select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long, n_whole long")
    return d.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return count(read(spark, sf_dir, "documents"), path or default_file())
