"""Suffix-array dedup: removes bytes of repeated 50-byte strings, all but the first document's.

1. Equal texts: all but the smallest doc_id are removed whole (by digest).
2. Anchors: each 50-byte string selects its k-gram of least hash, so equal
   strings select equal anchors. Chunks of documents send their sorted anchors,
   packed, and learn which of them other texts have too. One anchor in
   ``CUT_EVERY`` starts a block, which reaches as far into the next one as the
   strings of its anchors do. Chunks send the blocks' digests as well and learn
   the smallest doc that holds each repeated one: where that is another, the
   block is removed whole, and its strings are nobody's first, so its anchors are
   done. Then the same exchange for the 35 bytes up to and from each anchor left,
   one of which every string that holds the anchor contains.
3. Contexts: the bytes around shared anchors, as far as a 50-byte string that
   holds the anchor can reach. Equal contexts are one row with the smallest doc.
4. Shards of contexts get suffix arrays by induced sorting: suffixes are
   classified, leftmost-smaller (LMS) substrings are sorted by one induction and
   named; repeated names are ranked on the reduced string; a second
   induction from the sorted LMS suffixes gives the array, and permuted common
   prefixes (capped at 50) mark equal strings. Induction runs over whole queues
   of a first-byte bucket at a time. A string is removed from a context if
   an equal one belongs to a smaller doc.
   The contexts of one anchor that would overfill a shard are parted by the
   anchor's place in the string: strings of a part share a longer core, by which
   they are dealt anew, until a part fits or is a single string.
5. Marks return to their documents, where overlapping ones merge.

Defined results: null texts are empty; texts under 50 bytes keep everything.
Null doc_ids count as the largest. Rows of equal doc_id are no smaller than
each other, so neither loses bytes to the other. An empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, read, release
from .ngram_jaccard import BASE, _mix

SPAN, GRAM = 50, 20
WIDTH = SPAN - GRAM + 1
#: A string of SPAN bytes around an anchor holds the LONG bytes that end or begin with it.
LONG = GRAM + (SPAN - GRAM) // 2
CHUNK, PIECE, SHARD, CUT_EVERY, CUT_GAP = 4 << 20, 1 << 19, 3 << 20, 16, 64
LAST = (1 << 63) - 1  # a null doc_id
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_U = np.uint64


# --- anchors -------------------------------------------------------------


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    g = b.astype(_U)
    for k in (1, 2, 4):
        g = g[:-k] | (g[k:] << _U(8 * k))
    n = len(b) - GRAM + 1
    out = g[:n] * _U(0x9E3779B97F4A7C15) + _mix(g[8 : 8 + n]) + (g[GRAM - 8 : GRAM - 8 + n] ^ _U(0x5851F42D4C957F2D)) * _U(0xD1342543DE82EF95)
    return _mix(out)


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text, by pieces so that memory is bounded."""
    at, keys = [], []
    for a in range(0, len(b) - SPAN + 1, PIECE):
        h = _grams(b[a : a + PIECE + SPAN - 1])
        least = np.zeros(len(h) + WIDTH - 1, _U)
        least[WIDTH - 1 : len(h)] = _slide(h, WIDTH, np.minimum)
        sel = np.flatnonzero(_slide(least, WIDTH, np.maximum) == h)
        at.append(sel + a)
        keys.append(h[sel])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at, keys = np.concatenate(at), np.concatenate(keys)
    if len(b) > PIECE:
        at, first = np.unique(at, return_index=True)
        keys = keys[first]
    return at, keys >> _U(16)


_VALUE = _mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_POWER = np.multiply.accumulate(np.full(LONG, BASE, _U))


def _long_keys(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the hashes of the LONG bytes that end with its anchor and that begin with it; 0 where the text is too short."""
    out = []
    for q in (at - (LONG - GRAM), at):
        key = np.zeros(len(at), _U)
        for a in range(0, len(at), 4096):
            some = q[a : a + 4096]
            ok = (some >= 0) & (some + LONG <= len(b))
            key[a : a + 4096][ok] = _mix((_VALUE[b[some[ok][:, None] + np.arange(LONG)]] * _POWER).sum(1, dtype=_U)) >> _U(16)
        out.append(key)
    return out[0], out[1]


def pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


# --- suffix arrays -------------------------------------------------------


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The array that two induction passes make from LMS positions in the given order."""
    n, size = len(t), 256
    counts = np.bincount(t, minlength=size)
    head = np.concatenate([[0], np.cumsum(counts)[:-1]])
    tail = np.cumsum(counts)
    sa = np.full(n, -1, np.int64)
    present = np.flatnonzero(counts)
    order = np.argsort(t[lms], kind="stable")
    placed = lms[order]
    n_lms = np.bincount(t[placed], minlength=size)
    ends = np.cumsum(n_lms)
    for c in np.flatnonzero(n_lms):
        sa[tail[c] - n_lms[c] : tail[c]] = placed[ends[c] - n_lms[c] : ends[c]]

    fill = head.copy()

    def give(found, up):
        if not len(found):
            return
        chars = t[found]
        by = np.argsort(chars, kind="stable")
        found, chars = found[by], chars[by]
        cut = np.flatnonzero(np.diff(chars)) + 1
        for part in np.split(found, cut) if len(cut) else [found]:
            c = t[part[0]]
            if up:
                sa[fill[c] : fill[c] + len(part)] = part
                fill[c] += len(part)
            else:
                sa[fill[c] - len(part) : fill[c]] = part[::-1]
                fill[c] -= len(part)

    def before(block, want_small):
        found = block[block > 0] - 1
        return found[small[found] == want_small]

    for c in present:  # larger suffixes, left to right
        done = head[c]
        while done < fill[c]:
            block = sa[done : fill[c]].copy()
            done = fill[c]
            give(before(block, False), True)
        give(before(sa[tail[c] - n_lms[c] : tail[c]].copy(), False), True)
    larger = fill - head
    for c in np.flatnonzero(n_lms):
        sa[tail[c] - n_lms[c] : tail[c]] = -1
    fill = tail.copy()
    for c in present[::-1]:  # smaller suffixes, right to left
        done = tail[c]
        while done > fill[c]:
            block = sa[fill[c] : done][::-1].copy()
            done = fill[c]
            give(before(block, True), False)
        give(before(sa[head[c] : head[c] + larger[c]][::-1].copy(), True), False)
    sa[0] = n - 1  # nothing induces the end
    return sa


def _rank(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string, ranks of twice the length at each step."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 2) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a byte string whose last byte is its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(t.astype(np.int16)))
    turn = np.where(step != 0, np.arange(n - 1), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]  # the next position where the byte changes
    small = np.ones(n, bool)
    small[:-1] = step[turn] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) <= 1:
        return _induce(t, small, lms)
    sa = _induce(t, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by = sa[is_lms[sa]]  # LMS substrings in order
    end = np.full(n, n - 1, np.int64)
    end[lms[:-1]] = lms[1:]
    length = end[by] - by + 1
    differs = np.ones(len(by), bool)
    differs[1:] = length[1:] != length[:-1]
    live, k = np.flatnonzero(~differs), 0
    while len(live):  # compare neighbours byte by byte while they agree
        inside = k < length[live]
        live = live[inside]
        off = t[by[live] + k] != t[by[live - 1] + k]
        differs[live[off]] = True
        live = live[~off]
        k += 1
    name = np.zeros(n, np.int64)
    name[by] = np.cumsum(differs) - 1
    if differs.all():
        order = by
    else:
        order = lms[_rank(name[lms])]
    return _induce(t, small, order)


def repeats(texts: list[bytes], owner: np.ndarray) -> list[int]:
    """For each text a bit mask of the SPAN-byte strings that a text of a smaller owner holds."""
    sizes = np.array([len(x) for x in texts])
    # texts are shifted by one and parted by byte 1, so that 0 stays the end; byte 255 does not occur in UTF-8
    t = np.frombuffer(b"\xff".join(texts) + b"\xff\x00", np.uint8)
    t = np.where(t == 0, 254, t).astype(np.uint8)  # a NUL in a text becomes 254, which UTF-8 does not use either
    t[-1] = 0
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    sa = suffix_array(t)
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    starts = np.zeros(n, bool)  # where a whole string begins
    for a, m in zip(first.tolist(), sizes.tolist()):
        starts[a : a + m - SPAN + 1] = True
    # permuted common prefixes, capped at SPAN
    live = np.flatnonzero(starts & (phi >= 0))
    live = live[starts[phi[live]]]
    for k in range(SPAN):
        live = live[t[live + k] == t[phi[live] + k]]
    full = np.zeros(n, bool)
    full[live] = True
    inside = sa[starts[sa]]
    group = np.cumsum(~full[inside]) - 1
    mine = owner[text_of[inside]]
    least = np.full(group[-1] + 1 if len(group) else 0, LAST, np.int64)
    np.minimum.at(least, group, mine)
    gone = inside[least[group] < mine]
    masks = [0] * len(texts)
    for pos in gone.tolist():
        k = text_of[pos]
        masks[k] |= 1 << int(pos - first[k])
    return masks


def zipped(df: DataFrame, rows: int | None = None) -> DataFrame:
    return materialize(df, rows, codec="zstd")


# --- the join ------------------------------------------------------------


def _in(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _cuts(at: np.ndarray, keys: np.ndarray) -> list[int]:
    """Where blocks begin: the text's start and some anchors, ``CUT_GAP`` bytes apart at least."""
    out = [0]
    for p in at[keys % _U(CUT_EVERY) == 0].tolist():
        if p - out[-1] >= CUT_GAP:
            out.append(p)
    return out


def _blocks(raw: bytes, cuts: list[int]) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest); a block holds all strings of the anchors from SPAN - GRAM bytes after its start to as many after the next start.

    The last one may be too short for any string and then has no digest. Digests have no trailing zero bytes, as in numpy.
    """
    for a, b in zip(cuts, [*cuts[1:], len(raw)]):
        b = min(b + 2 * SPAN - GRAM, len(raw))
        yield a, b, hashlib.blake2b(raw[a:b], digest_size=16).digest().rstrip(b"\0") if b - a >= SPAN else b""


def _open_anchors(raw: bytes, at: np.ndarray, keys: np.ndarray, doc_id: int, least: dict[bytes, int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors are outside blocks that a smaller doc holds, and those blocks as (start, end), adjoining ones merged."""
    live, gone = np.ones(len(at), bool), []
    if least and len(at):
        cuts = _cuts(at, keys)
        first = np.searchsorted(at, [0, *(c + SPAN - GRAM for c in cuts[1:]), len(raw)])
        for k, (a, b, digest) in enumerate(_blocks(raw, cuts)):
            if least.get(digest, doc_id) < doc_id:
                live[first[k] : first[k + 1]] = False
                if gone and a <= gone[-1][1]:
                    a = gone.pop()[0]
                gone.append((a, b))
    return live, gone


_BLOCK = np.dtype([("digest", "S16"), ("doc", "<i8")])


def _told(told: pd.DataFrame) -> tuple[set, np.ndarray, dict[bytes, int], bytes]:
    """The chunk's first documents, the keys that it has been told of, and the repeated blocks with their smallest docs."""
    firsts = told[told["blob"].isna() & told["blocks"].isna()]
    blobs = [unpack(b) for b in told["blob"].dropna()]
    raw = b"".join(told["blocks"].dropna())
    known = np.frombuffer(raw, _BLOCK)
    least = dict(zip(known["digest"].tolist(), known["doc"].tolist()))
    return set(zip(firsts["doc_id"], firsts["th"])), np.unique(np.concatenate(blobs)) if blobs else np.zeros(0, _U), least, raw


def _key_rows(parts: int, long: bool):
    """A chunk's anchors and blocks, or the long keys of its shared anchors outside repeated blocks, packed by part; apart those that two of its texts have."""

    def run(key, docs, told):
        keep, known, least, raw_blocks = _told(told)
        some, blocks = [], {}
        for doc_id, th, text in zip(docs["doc_id"], docs["th"], docs["text"]):
            if (doc_id, th) not in keep or (long and not len(known)):
                continue
            keep.discard((doc_id, th))
            raw = (text or "").encode("utf-8", "surrogatepass")
            b = np.frombuffer(raw, np.uint8)
            at, keys = anchors(b)
            if long:
                live, _ = _open_anchors(raw, at, keys, doc_id, least)
                keys = np.concatenate(_long_keys(b, at[live & _in(known, keys)]))
                keys = keys[keys > 0]
            elif len(at):
                for digest in {d for _, _, d in _blocks(raw, _cuts(at, keys)) if d}:
                    blocks.setdefault(digest, []).append(doc_id)
            some.append(np.unique(keys))
        keys, times = np.unique(np.concatenate(some or [np.zeros(0, _U)]), return_counts=True)
        part = (keys % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, times, part = keys[order], times[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, key[0], pack(keys[a:b][times[a:b] == 1]), pack(keys[a:b][times[a:b] > 1]), None, None, None) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        if long and raw_blocks:
            rows.append((key[0] % parts, key[0], None, None, None, None, raw_blocks))  # told again
        dealt: dict[int, tuple[list, list]] = {}
        for digest, docs_of in blocks.items():
            dealt.setdefault(int.from_bytes(digest[:4], "little") % parts, ([], []))[len(docs_of) > 1].append((digest, min(docs_of)))
        rows += [(p, key[0], None, None, *(np.array(x, _BLOCK).tobytes() for x in two), None) for p, two in dealt.items()]
        return pd.DataFrame(rows, columns=["part", "chunk", "here", "twice", "once", "several", "again"])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk the keys that another text has too, and the blocks with their smallest docs."""
    sent = pdf[pdf["here"].notna()]
    here = [unpack(b) for b in sent["here"]]
    twice = [unpack(b) for b in sent["twice"]]
    keys, times = np.unique(np.concatenate([np.zeros(0, _U), *here, *twice, *twice]), return_counts=True)
    known = keys[times > 1]
    out = [(c, 0, 0, pack(np.concatenate([h[np.isin(h, known, assume_unique=True)], w])), None) for c, h, w in zip(sent["chunk"], here, twice)]
    out += [(c, 0, 0, None, b) for c, b in zip(pdf["chunk"], pdf["again"]) if b is not None]
    sent = pdf[pdf["once"].notna()]
    if len(sent):
        blocks = [np.frombuffer(b"".join(x), _BLOCK) for x in zip(sent["once"], sent["several"])]
        every = np.concatenate(blocks + [np.frombuffer(b, _BLOCK) for b in sent["several"]])
        digests, place, times = np.unique(every["digest"], return_inverse=True, return_counts=True)
        least = np.full(len(digests), LAST, np.int64)
        np.minimum.at(least, place, every["doc"])
        for c, mine in zip(sent["chunk"], blocks):
            at = np.searchsorted(digests, mine["digest"])
            at = at[times[at] > 1]
            if len(at):
                some = np.empty(len(at), _BLOCK)
                some["digest"], some["doc"] = digests[at], least[at]
                out.append((c, 0, 0, None, some.tobytes()))
    return pd.DataFrame(out, columns=["chunk", "doc_id", "th", "blob", "blocks"])


def _context_rows(key, docs, told):
    """Contexts of the anchors with a shared long key, equal ones in one row, with all their places; in a row without an anchor the removed blocks."""
    keep, known, least, _ = _told(told)
    found: dict[tuple, list] = {}
    spans = []
    for doc_id, th, text in zip(docs["doc_id"], docs["th"], docs["text"]) if len(known) or least else ():
        if (doc_id, th) not in keep:
            continue
        keep.discard((doc_id, th))
        raw = (text or "").encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8)
        at, keys = anchors(b)
        live, gone = _open_anchors(raw, at, keys, doc_id, least)
        spans += [(doc_id, th, a, e - a) for a, e in gone]
        at, keys = at[live], keys[live]
        if not len(known) or not len(at):
            continue
        left, right = _long_keys(b, at)
        hit = _in(known, left) | _in(known, right)
        for p, k in zip(at[hit].tolist(), keys[hit].tolist()):
            a = max(0, p - (SPAN - GRAM))
            found.setdefault((k, p - a, raw[a : p + SPAN]), []).append((doc_id, th, a))
    rows = [(key[0], k, left, ctx, min(d for d, _, _ in where), np.array(where, np.int64).tobytes()) for (k, left, ctx), where in found.items()]
    if spans:
        rows.append((key[0], None, None, None, None, np.array(spans, np.int64).tobytes()))
    return pd.DataFrame({c: pd.array([r[k] for r in rows], t) for k, (c, t) in enumerate([("chunk", "Int32"), ("anchor", "Int64"), ("lead", "Int32"), ("ctx", "object"), ("doc", "Int64"), ("places", "object")])})


def _shard_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    masks = repeats([bytes(c) for c in pdf["ctx"]], pdf["owner"].to_numpy())
    return pd.DataFrame({"id": pdf["id"], "owner": pdf["owner"], "mask": masks})


CONTEXT = "id long, key long, low int, high int, lead int, ctx binary, owner long"


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts of strings whose anchor is ``low`` to ``high`` bytes in, parted into quarters of that range: the strings of a quarter share a core, the new key."""
    for pdf in batches:
        rows = []
        for parent, key, low, high, lead, ctx, owner in pdf[["id", "key", "low", "high", "lead", "ctx", "owner"]].itertuples(index=False, name=None):
            width = -(-(high - low + 1) // 4)
            for first in range(low, high + 1, width):
                last = min(first + width - 1, high)
                a, b = max(0, lead - last), lead - first + SPAN
                core = ctx[lead - first : lead - last + SPAN]
                if lead < first or len(core) < SPAN - (last - first):
                    continue
                part = ctx[a:b]
                name = lambda *x: int.from_bytes(hashlib.blake2b(b"|".join(x), digest_size=8).digest(), "little", signed=True)
                about = f"{key},{first},{last}".encode()
                new = name(about, core)
                rows.append((parent, owner, a, name(about, str(lead - a).encode(), part), new, first, last, lead - a, part))
        yield pd.DataFrame(rows, columns=["parent", "parent_owner", "shift", "id", "key", "low", "high", "lead", "ctx"])


def marks_of(owned: DataFrame) -> DataFrame:
    """(id, mask) of the contexts (``CONTEXT``, one row an id) with strings that a context of the same key and a smaller owner has."""
    several = owned.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.octet_length("ctx")).alias("size")).where("m > 1")
    several = zipped(several, 0)
    size = several.where(f"size <= {SHARD}").agg(F.sum("size")).first()[0] or 0
    shard = F.pmod(F.xxhash64("key"), F.lit(max(12, -(-size // SHARD))))
    some = owned.join(several.where(f"size <= {SHARD}").select("key"), "key").withColumn("shard", shard)
    marks = zipped(some.groupBy("shard").applyInPandas(_shard_rows, "id long, owner long, mask long").where("mask <> 0").select("id", "mask"))
    hot = several.where(f"size > {SHARD}")
    if not hot.take(1):
        return marks
    parts = owned.join(hot.select("key"), "key").select("id", "key", "low", "high", "lead", "ctx", "owner")
    parts = zipped(parts.mapInPandas(_parts, "parent long, parent_owner long, shift int, id long, key long, low int, high int, lead int, ctx binary"))
    firsts = [F.first(c).alias(c) for c in ("key", "low", "high", "lead", "ctx")]
    one = zipped(parts.groupBy("id").agg(*firsts, F.min("parent_owner").alias("owner")))
    below = one.select("id", "owner").join(marks_of(one), "id", "left")
    back = parts.select("parent", "parent_owner", "shift", "id", F.octet_length("ctx").alias("size")).join(below, "id")
    all_of = F.expr(f"shiftleft(1L, size - {SPAN - 1}) - 1")
    mask = F.when(F.col("owner") < F.col("parent_owner"), all_of).otherwise(F.coalesce("mask", F.lit(0).cast("long")))
    back = back.select("parent", F.call_function("shiftleft", mask, F.col("shift")).alias("mask")).where("mask <> 0")
    return marks.union(zipped(back.groupBy("parent").agg(F.bit_or("mask").alias("mask"))))


def _cut_rows(key, docs, marks):
    """The kept bytes of each marked document."""
    by: dict[tuple, list] = {}
    for owner, mask, size, places in zip(marks["owner"], marks["mask"], marks["size"], marks["places"]):
        if size:
            for doc_id, th, a in np.frombuffer(places, np.int64).reshape(-1, 3).tolist():
                by.setdefault((doc_id, th), []).append((a, size, None if doc_id > owner else mask))
        else:
            for doc_id, th, a, n in np.frombuffer(places, np.int64).reshape(-1, 4).tolist():
                by.setdefault((doc_id, th), []).append((a, n, None))
    rows = []
    for doc_id, th, text in zip(docs["doc_id"], docs["th"], docs["text"]):
        if (spans := by.pop((doc_id, th), None)) is None:
            continue
        b = _bytes(text)
        edge = np.zeros(len(b) + 1, np.int64)
        for a, size, mask in spans:
            if mask is None:
                edge[a] += 1
                edge[a + size] -= 1
            else:
                while mask:
                    low = mask & -mask
                    k = a + low.bit_length() - 1
                    edge[k] += 1
                    edge[k + SPAN] -= 1
                    mask ^= low
        gone = np.cumsum(edge[:-1]) > 0
        n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        rows.append((doc_id, th, int(gone.sum()), n_spans, hashlib.sha256(b[~gone].tobytes()).hexdigest(), b[~gone].tobytes()))
    return pd.DataFrame(rows, columns=["doc_id", "th", "n_removed", "n_spans", "kept_sha256", "kept"])


def removals(documents: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes where some are removed)."""
    text = F.coalesce("text", F.lit(""))
    base = documents.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    narrow = zipped(base.select("own_id", "doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    chunks = max(16, -(-total // CHUNK))
    parts = max(32, chunks // 8)
    chunk = F.pmod(F.xxhash64("doc_id", "th"), F.lit(chunks)).cast("int")
    first = narrow.where(f"n_bytes >= {SPAN}").groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("th").alias("th"))
    first = zipped(first.select("doc_id", "th", "sha"))
    none = F.lit(None).cast("binary")
    firsts = first.select(chunk.alias("chunk"), "doc_id", "th", none.alias("blob"), none.alias("blocks"))
    docs = base.select(chunk.alias("chunk"), "doc_id", "th", "text").groupBy("chunk")

    def shared(told: DataFrame, long: bool) -> DataFrame:
        sent = docs.cogroup(told.groupBy("chunk")).applyInPandas(_key_rows(parts, long), "part int, chunk int, here binary, twice binary, once binary, several binary, again binary")
        return sent.groupBy("part").applyInPandas(_shared, "chunk int, doc_id long, th long, blob binary, blocks binary").union(firsts)

    known = shared(shared(firsts, False), True)
    contexts = docs.cogroup(known.groupBy("chunk")).applyInPandas(_context_rows, "chunk int, anchor long, lead int, ctx binary, doc long, places binary")
    contexts = zipped(contexts.withColumn("id", F.xxhash64("anchor", "lead", "ctx")))

    found = contexts.where("anchor is not null")
    owned = found.groupBy("id", "anchor", "lead", "ctx").agg(F.min("doc").alias("owner"))
    owned = zipped(owned.select("id", F.col("anchor").alias("key"), F.lit(0).alias("low"), F.lit(SPAN - GRAM).alias("high"), "lead", "ctx", "owner"))
    state = zipped(owned.select("id", "owner").join(marks_of(owned), "id", "left"))
    release(owned)
    told = found.select("id", "chunk", "ctx", "doc", "places").join(state, "id").where("mask is not null or octet_length(places) > 24 or doc > owner")
    told = told.select("chunk", "owner", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"), F.octet_length("ctx").alias("size"), "places")
    zero = F.lit(0).cast("long")
    told = told.union(contexts.where("anchor is null").select("chunk", zero, zero, F.lit(0), "places"))
    cut = docs.cogroup(told.groupBy("chunk")).applyInPandas(_cut_rows, "doc_id long, th long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = cut if keep_bytes else cut.drop("kept")
    whole = narrow.join(first.select("sha", F.col("doc_id").alias("first_id")), "sha", "left").join(cut, ["doc_id", "th"], "left")
    copy = F.col("first_id") < F.col("doc_id")
    pick = lambda for_copy, name, other: F.when(copy, for_copy).otherwise(F.coalesce(F.col(name), other))
    out = [
        F.col("own_id").alias("doc_id"), "n_bytes",
        pick(F.col("n_bytes"), "n_removed", F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(EMPTY_SHA), "kept_sha256", F.col("sha")).alias("kept_sha256"),
    ]
    return whole.select(*out, *(["kept"] if keep_bytes else []))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read(spark, sf_dir, "documents"))
