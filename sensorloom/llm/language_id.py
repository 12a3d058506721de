"""Language identification by interpolated Kneser-Ney character models.

One model of ``ORDER`` characters per language is fitted on a bounded sample:
at most ``SAMPLE`` documents a language, none over ``SAMPLE_CHARS`` characters
(documented bounds; only training is sampled, every whole text is predicted).
N-grams are exact keys of 15 bits a letter (the 32,766 most frequent ones of the sample; further ones count as unknown) kept in sorted arrays, with the log
probabilities of all languages side by side, so that one binary search a
character scores every language. The language of the lowest length-normalised
cross-entropy wins. A quarter of the sample calibrates the rejection bound of
each language's cross-entropy.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected. Characters unseen in training count as one unknown letter. With
no usable training row every text is ``und``. Copies get equal answers; columns
other than doc_id, text and lang are ignored, and lang only in training.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import slices_of
from .common import as_text, bounded, longs, read, trimmed

ORDER, BITS, DISCOUNT = 4, 15, 0.75
SAMPLE, SAMPLE_CHARS = 240, 20_000
#: A text is rejected beyond the calibration rows' largest cross-entropy times this, plus half a nat.
SLACK, SHARP = 1.25, 30
UNKNOWN = 1  # 0 is anything that is no letter


@lru_cache(1)
def letters() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with runs of non-letters as one 0, their text's number, letters a text."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    sym = table[cp]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep], doc[keep]
    return sym.astype(np.int64), doc, np.bincount(doc[sym != 0], minlength=len(texts))


def _keys(sym: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The ORDER symbols that end at each position as one key; before a text stand zeros."""
    key = sym.copy()
    for j in range(1, ORDER):
        same = doc[j:] == doc[:-j]
        key[j:] |= np.where(same, sym[:-j], 0) << (BITS * j)
    return key


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class KneserNey:
    """Counts of one language as sorted arrays: by order, n-grams and contexts."""

    def __init__(self, keys: np.ndarray, size: int):
        self.size = size
        self.grams, self.contexts = {}, {}
        grams, counts = np.unique(keys, return_counts=True)
        for m in range(ORDER, 0, -1):
            self.grams[m] = grams, counts.astype(float)
            ctx, inv = np.unique(grams >> BITS, return_inverse=True)  # distinct followers: n1, their counts: total
            self.contexts[m] = ctx, np.bincount(inv, counts), np.bincount(inv).astype(float)
            suffix = grams & ((1 << BITS * (m - 1)) - 1)
            grams, counts = np.unique(suffix, return_counts=True)  # continuation counts

    def prob(self, keys: np.ndarray, m: int = ORDER) -> np.ndarray:
        if m == 0:
            return np.full(len(keys), 1 / self.size)
        lower = self.prob(keys & ((1 << BITS * (m - 1)) - 1), m - 1)
        grams, counts = self.grams[m]
        ctx, total, n1 = self.contexts[m]
        at, seen = _find(ctx, keys >> BITS)
        g, hit = _find(grams, keys)
        have = np.where(hit, np.maximum(counts[g] - DISCOUNT, 0), 0)
        return np.where(seen, (have + DISCOUNT * n1[at] * lower) / total[at], lower)


@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray  # lower-cased code points, sorted; the symbol is the place plus 2
    models: list[KneserNey]
    grams: np.ndarray = None
    logp: np.ndarray = None
    bound: np.ndarray = None

    def __post_init__(self):
        if self.models:
            self.grams = np.unique(np.concatenate([m.grams[ORDER][0] for m in self.models]))
            self.logp = np.stack([np.log(m.prob(self.grams)) for m in self.models], 1).astype(np.float32)

    def table(self) -> np.ndarray:
        low = letters()
        at, hit = _find(self.symbols, low)
        return np.where(low == 0, 0, np.where(hit, at + 2, UNKNOWN)).astype(np.uint16)

    def entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character (nats) by text and language, and the number of letters."""
        out = np.zeros((len(texts), len(self.langs)))
        if not any(texts):
            return out, np.zeros(len(texts), int)
        sym, doc, n = _symbols(texts, table)
        keys = _keys(sym, doc)
        at, hit = _find(self.grams, keys)
        rows = self.logp[at]
        if not hit.all():
            odd, inv = np.unique(keys[~hit], return_inverse=True)
            rows[~hit] = np.stack([np.log(m.prob(odd)) for m in self.models], 1).astype(np.float32)[inv]
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        sums = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        out[doc[starts]] = -sums / np.diff(np.append(starts, len(doc)))[:, None]
        return out, n


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit and calibrate on (lang, text) rows; every fourth row of a language calibrates."""
    by: dict[str, list[str]] = {}
    for lang, text in sorted(rows):
        by.setdefault(lang, []).append(text)
    langs = sorted(by)
    low = letters()
    seen: dict[int, int] = {}
    for texts in by.values():
        cp = low[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        for c, k in zip(*(x.tolist() for x in np.unique(cp[cp > 0], return_counts=True))):
            seen[c] = seen.get(c, 0) + k
    symbols = np.array(sorted(sorted(seen, key=lambda c: (-seen[c], c))[: (1 << BITS) - 2]), np.uint32)
    model = Model(langs, symbols, [])
    table = model.table()
    fit, check = {}, {}
    for lang in langs:
        texts = by[lang]
        check[lang] = texts[3::4] if len(texts) >= 8 else texts
        fit[lang] = [t for k, t in enumerate(texts) if k % 4 != 3] if len(texts) >= 8 else texts
    models = [KneserNey(_keys(*_symbols(fit[lang], table)[:2]), len(symbols) + 2) for lang in langs]
    model = Model(langs, symbols, models)
    model.bound = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        h, n = model.entropies(check[lang], table)
        model.bound[k] = (h[n > 0, k].max() if (n > 0).any() else 0) * SLACK + 0.5
    return model


def labelled_sample(documents: DataFrame) -> list[tuple[str, str]]:
    """At most SAMPLE (lang, text) rows a language of the training folds, drawn by hash."""
    rows = documents.where("lang is not null and text is not null and doc_id is not null").where(f"length(text) between 1 and {SAMPLE_CHARS}")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("h"))
    share = rows.groupBy("lang").agg((F.lit(SAMPLE * 1.5e6) / F.count("*") + 50).alias("upto"))
    few = rows.join(F.broadcast(share), "lang").where("h < upto")  # one row a language
    best: dict[str, list[tuple[int, str]]] = {}
    for lang, text, h in few.select("lang", "text", "h").collect():  # about 1.5 SAMPLE a language
        best.setdefault(lang, []).append((h, text))
    return [(lang, t) for lang, some in best.items() for _, t in sorted(some)[:SAMPLE]]


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected and the best cross-entropy of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        m = shared.value
        table = m.table() if m.models else None
        for pdf in batches:
            texts = pdf["text"].where(pdf["text"].notna(), "").tolist()
            at = 0
            for some in slices_of(texts, 1 << 18):
                ids = longs(pdf["doc_id"].iloc[at : at + len(some)])
                at += len(some)
                if m.models:
                    h, n = m.entropies(some, table)
                    best = h.argmin(1)
                    low = h[np.arange(len(some)), best]
                    sharp = np.minimum(n, SHARP)[:, None]
                    score = 1 / np.exp(np.maximum(-(h - low[:, None]) * sharp, -700)).sum(1)
                    none, over = n == 0, low > m.bound[best]
                    langs = np.where(none, "und", np.array(m.langs, object)[best])
                else:
                    none = over = np.ones(len(some), bool)
                    low, score, langs = np.zeros(len(some)), np.zeros(len(some)), ["und"] * len(some)
                yield pd.DataFrame({"doc_id": ids, "lang_pred": langs, "score": np.where(none, 0.0, score),
                                    "rejected": none | over, "cross_entropy": np.where(none, 0.0, low)})

    return bounded(documents).select(as_text("doc_id"), "text").mapInPandas(trimmed(run), "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")


def keep_accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, all columns unchanged."""
    shared, schema = documents.sparkSession.sparkContext.broadcast(model), documents.schema

    def run(batches):
        m = shared.value
        table = m.table() if m.models else None
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            keep = np.zeros(len(texts), bool)
            at = 0
            for some in slices_of(texts, 1 << 18) if m.models else ():
                h, n = m.entropies(some, table)
                keep[at : at + len(some)] = (n > 0) & (h.min(1) <= m.bound[h.argmin(1)])
                at += len(some)
            yield b.filter(pa.array(keep))

    return bounded(documents).mapInArrow(trimmed(run), schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(labelled_sample(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
