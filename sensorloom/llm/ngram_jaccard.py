"""Exact n-gram Jaccard join: metric regions around pivots, joined recursively.

Documents with equal shingle sets are one node. The set is also kept as a count
vector of 64 bins or more (eight shingles a bin at most, on average), whose L1
distance never exceeds the sets' symmetric difference: a cheap window by the
triangle inequality that rules pairs out exactly.

1. Word-shingle sets, hashed to 64 bits. Shingles frequent within a chunk of
   documents are noted; the total's most frequent ones (at most ``HOT_MAX``,
   documented) are ordered last. The order matters for speed only.
2. Prefix regions: two linked sets share a shingle among the first
   n - ceil(0.8 n) + 1 of either. Sets that share one meet; those that the
   vectors do not rule out are tied, and ties make regions.
3. Every region, small or large, takes rounds of pivots, each compared with the
   whole region: sets within 0.2 of a pivot are linked to it, and each set belongs
   to its nearest pivot's Voronoi cell. A pair can only matter if its sets are not
   connected yet, so one of them is outside the region's main component. An
   outsider can only be linked to sets whose distance to its cell's pivot is
   within 0.2 of its own; those boundary sets stay with it, all others leave, and
   cells are joined the same way, with outsiders as the next pivots, until none is
   left. Regions that one task can hold and join take their rounds in it; for
   larger ones each round is a few Spark joins, until what is left fits.
4. Links' connected components.

Pivots alone do not separate sparse sets (nearly all distances are 1, so every
window holds every document); the prefix regions bound what pivots must split.

Defined results: null, empty and blank texts have no shingles and are their own
component. Fewer than five words form one shingle. A null doc_id has a null
component if nothing smaller is reachable; rows of equal doc_id are joined by
their texts. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import slices_of
from .common import as_text, bounded, fresh, longs, materialize, read, release, trimmed
from .components import components

WORDS, BINS, BATCH_CHARS = 5, 64, 1 << 18
CHUNK, CHUNK_TIMES, HOT_TIMES, HOT_MAX, SALTS = 4_000_000, 3, 32, 200_000, 64
MEETING_ROWS, TIE_ROWS = 400_000, 100_000
LOCAL_SHINGLES, LOCAL_WORK, PIVOTS = 2_000_000, 1_000_000_000, 16
NEAR = 0.2

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTES[65:91] = _BYTES[97:123]  # A-Z are as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse modulo 2**64."""
    up, down = np.full(size, BASE, _U), np.full(size, pow(BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    if not raw:
        return []
    text_end = np.cumsum([len(r) + 1 for r in raw])
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]  # the last byte is blank, so each word ends
    up, down = _powers(1 << max(19, int(len(buf)).bit_length()))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[buf] * up[: len(buf)], dtype=_U)])
    word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    doc = np.searchsorted(text_end, start, "right")
    counts = np.bincount(doc, minlength=len(raw))
    first = np.concatenate([[0], np.cumsum(counts)])
    roll = np.zeros(max(len(word) - WORDS + 1, 0), _U)
    for j in range(WORDS):
        roll = roll * _U(BASE) + word[j : j + len(roll)]
    roll = _mix(roll + _U(WORDS))
    out = []
    for k, n in enumerate(counts.tolist()):
        a = first[k]
        if n >= WORDS:
            h = np.sort(roll[a : a + n - WORDS + 1])
            keep = np.empty(len(h), bool)
            keep[0] = True
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            out.append(h[keep])
        elif n:
            h = np.zeros(1, _U)
            for w in word[a : a + n]:
                h = h * _U(BASE) + w
            out.append(_mix(h + _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bins_of(s: np.ndarray) -> bytes:
    size = BINS
    while size * 8 < len(s):
        size *= 2
    return np.bincount((s & _U(size - 1)).astype(np.int64), minlength=size).astype(np.uint16).tobytes()


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for pdf in batches:
        texts, at = pdf["text"].where(pdf["text"].notna(), "").tolist(), 0
        for some in slices_of(texts, BATCH_CHARS):
            yield pdf.iloc[at : at + len(some)], shingle_sets(some)
            at += len(some)


def nodes(documents: DataFrame) -> DataFrame:
    """Rows of two kinds: documents (doc_id, node, n, bins) and shingles frequent in a chunk (node, n)."""

    def run(batches):
        held, size, seen = [], 0, set()

        def frequent():
            got, times = np.unique(np.concatenate(held), return_counts=True)
            got, times = got[times >= CHUNK_TIMES], times[times >= CHUNK_TIMES]
            return pd.DataFrame({"kind": 1, "doc_id": pd.array([None] * len(got), "Int64"), "node": _signed(got), "n": times, "bins": None})

        for pdf, sets in _sets(batches):
            ids = [node_of(s) for s in sets]
            yield pd.DataFrame({"kind": 0, "doc_id": longs(pdf["doc_id"]), "node": ids, "n": [len(s) for s in sets], "bins": [bins_of(s) for s in sets]})
            for k, s in zip(ids, sets):
                if len(s) and k not in seen:
                    seen.add(k)
                    held.append(s)
                    size += len(s)
            if size > CHUNK:
                yield frequent()
                held, size, seen = [], 0, set()
        if held:
            yield frequent()

    return bounded(documents).select(as_text("doc_id"), "text").mapInPandas(trimmed(run), "kind int, doc_id long, node long, n long, bins binary")


def prefixes(documents: DataFrame, hot: np.ndarray) -> DataFrame:
    """(shingle, salt, node) of each set's prefix; salt is negative for shingles that are not hot."""
    shared = documents.sparkSession.sparkContext.broadcast(hot)  # at most HOT_MAX values

    def run(batches):
        last, seen = shared.value, set()
        for _, sets in _sets(batches):
            tokens, salts, owners = [], [], []
            for s in sets:
                if not len(s) or (k := node_of(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(k)
                n = len(s)
                size = n - (80 * n + 99) // 100 + 1
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    is_hot = last[at] == s
                    s = np.concatenate([s[~is_hot], s[is_hot]])[:size]
                    salt = np.where(np.arange(n) < n - is_hot.sum(), -1, k % SALTS)[:size]
                else:
                    s, salt = s[:size], np.full(size, -1)
                tokens.append(s)
                salts.append(salt)
                owners.append(np.full(size, k))
            if tokens:
                yield pd.DataFrame({"shingle": _signed(np.concatenate(tokens)), "salt": np.concatenate(salts).astype(np.int32), "node": np.concatenate(owners)})

    return bounded(documents).select("text").mapInPandas(trimmed(run), "shingle long, salt int, node long")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew where ``keys`` change, at about ``rows`` rows: memory holds these and one group."""
    held, size = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(1))
        cut = int(last[-1]) + 1 if len(last) else 0  # where the last group begins
        if held and size >= rows and (cut or (held[-1][keys].to_numpy()[-1] != k[-1]).any()):
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held, size, pdf = [], 0, pdf.iloc[cut:]
        held.append(pdf)
        size += len(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted prefix rows -> kind 0: (group, member); kind 1: (node, node) ties; kind 2: (hot shingle, its least node here)."""
    for pdf in whole_groups(batches, ["shingle", "salt"], MEETING_ROWS):
        shingle, salt, node = pdf["shingle"].to_numpy(), pdf["salt"].to_numpy(), pdf["node"].to_numpy()
        same = np.empty(len(node), bool)
        same[0] = False
        same[1:] = (shingle[1:] == shingle[:-1]) & (salt[1:] == salt[:-1])
        keep = ~same
        keep[1:] |= node[1:] != node[:-1]
        shingle, salt, node, same = shingle[keep], salt[keep], node[keep], same[keep]
        start = np.flatnonzero(~same)
        size = np.diff(np.append(start, len(node)))
        hot = salt[start] >= 0
        lead = np.repeat(node[start], size)
        # groups of the same members count once: the sum of the members' mixed hashes names them
        name = np.add.reduceat(_mix(node.view(_U)), start) ^ size.astype(_U)
        cold = ~hot & (size > 1)
        _, first = np.unique(name[cold], return_index=True)
        rows = np.zeros(len(start), bool)
        rows[np.flatnonzero(cold)[first]] = True
        member = np.repeat(rows, size)
        yield pd.DataFrame({"kind": 0, "a": _signed(np.repeat(name, size)[member]), "b": node[member]})
        tied = np.repeat(hot, size) & same
        yield pd.DataFrame({"kind": 1, "a": lead[tied], "b": node[tied]}).drop_duplicates()
        yield pd.DataFrame({"kind": 2, "a": shingle[start][hot], "b": node[start][hot]})


class Vectors:
    """Count vectors of sets in ascending size; where a longer vector meets one half as long, it is folded."""

    def __init__(self, size: np.ndarray, bins):
        self.size, self.length = size, np.fromiter((len(b) // 2 for b in bins), np.int64, len(bins))
        self.rows, self.folded = {}, {}
        for n in np.unique(self.length).tolist():
            a, b = np.searchsorted(self.length, [n, n + 1])
            m = np.frombuffer(b"".join(bins[a:b]), np.uint16).reshape(-1, n).astype(np.int32)
            self.rows[n], self.folded[n // 2] = (a, m), (a, m.reshape(len(m), 2, n // 2).sum(1, dtype=np.int32))

    def close(self, k: int) -> np.ndarray:
        """Places after k whose vectors allow a link: L1 <= (|A| + |B|) / 9 and a size ratio of 0.8 or more."""
        n = int(self.length[k])
        end, (first, m) = int(np.searchsorted(self.size, self.size[k] * 1.25 + 1e-9, "right")), self.rows[n]
        mine, out = m[k - first], []
        for a, other in ((first, m), self.folded.get(n, (end, m[:0]))):
            lo, hi = max(a, k + 1), min(a + len(other), end)
            if hi > lo:
                l1 = np.abs(other[lo - a : hi - a] - mine).sum(1)
                out.append(lo + np.flatnonzero(9 * l1 <= self.size[k] + self.size[lo:hi]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _ties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning ties among the members of each group that their vectors do not rule out; rows come sorted by (a, n, b)."""
    for pdf in whole_groups(batches, ["a"], TIE_ROWS):
        group, size, node, bins = pdf["a"].to_numpy(), pdf["n"].to_numpy(), pdf["b"].to_numpy(), pdf["bins"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.append(start, len(group)))
        length = np.fromiter((len(b) for b in bins), np.int64, len(bins))
        two = start[(count == 2)]
        two = two[(length[two] == 2 * BINS) & (length[two + 1] == 2 * BINS)]  # most groups: compared at once
        flat = lambda at: np.frombuffer(b"".join(bins[at]), np.uint16).reshape(-1, BINS).astype(np.int32)
        ok = two[9 * np.abs(flat(two) - flat(two + 1)).sum(1) <= size[two] + size[two + 1]]
        out = [pd.DataFrame({"a": node[ok], "b": node[ok + 1]})]
        found = []
        rest = ~np.isin(start, two) & (count > 1)
        for a, m in zip(start[rest].tolist(), count[rest].tolist()):
            trees, vectors = Forest(m), Vectors(size[a : a + m], bins[a : a + m])
            for k in range(m - 1):
                found += [(node[a + k], node[a + j]) for j in vectors.close(k).tolist() if trees.join(k, j)]
        out.append(pd.DataFrame(found, columns=["a", "b"], dtype="int64"))
        yield pd.concat(out).drop_duplicates()


class Sets:
    """Sorted shingle sets end to end, so that one set meets many at once."""

    def __init__(self, raw: list[bytes]):
        self.size = np.fromiter((len(b) // 8 for b in raw), np.int64, len(raw))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(raw), _U)

    def common(self, q: np.ndarray, some: np.ndarray) -> np.ndarray:
        """How many shingles of ``q`` each of the sets ``some`` has."""
        size = self.size[some]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        s = self.flat[np.repeat(self.first[some] - start, size) + np.arange(size.sum())]
        return np.add.reduceat((q[np.minimum(np.searchsorted(q, s), len(q) - 1)] == s).astype(np.int64), start)

    def far(self, q: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of ``some`` from ``q``, and which are links."""
        common, both = self.common(q, some), self.size[some] + len(q)
        return 1 - common / (both - common), 100 * common >= 80 * (both - common)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.first[k] : self.first[k + 1]]


def windows(far: np.ndarray, outside: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(outsiders, cell) of each Voronoi cell with an outsider.

    ``far`` is pivots by sets. A set belongs to its nearest pivot. By the triangle
    inequality a set linked to an outsider of the cell is as far from its pivot,
    give or take ``NEAR``; those sets make up the cell, whatever theirs is.
    """
    home, out = far.argmin(0), []
    for p in np.unique(home[outside]).tolist():
        mine = outside & (home == p)
        lo, hi = far[p, mine].min() - NEAR - 1e-9, far[p, mine].max() + NEAR + 1e-9
        out.append((mine, (far[p] >= lo) & (far[p] <= hi)))
    return out


def local_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning links of one region, exactly, by rounds of pivots, cells and windows.

    A pair matters only while its sets are not connected, so one of them is outside
    the largest component. Only those sets, or only those at home in the cell at
    hand if they are fewer, are pivots in turn; after a pivot's round all of its
    links are known and it leaves. So no more rounds are left than there are sets.
    """
    pdf = pdf.drop_duplicates("node").sort_values(["n", "node"])
    node, sets, trees, out = pdf["node"].to_numpy(), Sets(pdf["shingles"].tolist()), Forest(len(pdf)), []
    work = [(np.arange(len(pdf)), np.ones(len(pdf), bool))]  # sets in ascending size, and which are at home
    while work:
        some, mine = work.pop()
        where = np.flatnonzero(mine)
        chosen = where[np.unique(np.linspace(0, len(where) - 1, PIVOTS).astype(np.int64))]
        far = np.empty((len(chosen), len(some)))
        for k, p in enumerate(some[chosen].tolist()):
            far[k], linked = sets.far(sets[p], some)
            for j in some[linked].tolist():
                if trees.join(p, j):
                    out.append((node[p], node[j]))
        rest = np.ones(len(some), bool)
        rest[chosen] = False
        if not rest.any():
            continue
        roots = np.fromiter(map(trees.root, some.tolist()), np.int64, len(some))
        names, times = np.unique(roots[rest], return_counts=True)
        outside = min(rest & mine, rest & (roots != names[times.argmax()]), key=np.count_nonzero)
        sizes = sets.size[some]
        for home, cell in windows(far, outside) if outside.any() else ():
            cell &= rest & (sizes >= 0.8 * sizes[home].min()) & (0.8 * sizes <= sizes[home].max())
            if len(np.unique(roots[cell])) > 1:
                work.append((some[cell], home[cell]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _distances(key, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Some rows of a region with the distances from its pivots, in the pivots' order, and the pivots that they are linked to."""
    pivots = pivots.sort_values("pivot")
    sets, every = Sets(rows["shingles"].tolist()), np.arange(len(rows))
    if not len(rows):
        return pd.DataFrame([], columns=["region", "node", "far", "links"])
    far, linked = zip(*(sets.far(np.frombuffer(b, _U), every) for b in pivots["pivot_shingles"]))
    ids, far, linked = pivots["pivot"].to_numpy(), np.stack(far, 1), np.stack(linked, 1)
    return pd.DataFrame({"region": key[0], "node": rows["node"], "far": list(far), "links": [ids[x] for x in linked]})


SETS = ["region", "node", "n", "shingles"]


def region_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked sets of each region; sets has the columns ``SETS``.

    A region that one task can hold and join (``LOCAL_SHINGLES``, ``LOCAL_WORK``)
    goes to one. A larger one takes the same rounds as joins, with twice as many
    pivots each time, until what is left fits or no outsider is left.
    """
    measure = lambda df: df.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    fits = f"total <= {LOCAL_SHINGLES} and m * total <= {LOCAL_WORK}"
    by_task = lambda df: materialize(df.groupBy("region").applyInPandas(local_links, "a long, b long"))
    count = materialize(measure(sets), 0)
    found = [by_task(sets.join(count.where(fits).select("region"), "region").select(SETS))]
    large = count.where(f"not ({fits})")
    if not large.take(1):
        return found[0]
    left = materialize(sets.join(large, "region").select(*SETS, "m", F.lit(True).alias("outside")))
    k = PIVOTS
    while left.take(1):
        salts = F.greatest(F.ceil(F.col("m") / 1000), F.lit(1)).cast("int")
        chosen = left.where("outside").groupBy("region", F.pmod(F.xxhash64("node"), F.lit(k))).agg(F.min("node").alias("node")).select("region", "node")
        some = left.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).select("region", "salt", "node", "shingles")
        pivots = left.join(chosen, ["region", "node"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))  # k a region and salt
        pivots = pivots.select(F.col("region").alias("_region"), F.col("salt").alias("_salt"), F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
        seen = some.groupBy("region", "salt").cogroup(pivots.groupBy("_region", "_salt"))
        seen = materialize(seen.applyInPandas(_distances, "region long, node long, far array<double>, links array<long>"))
        found.append(seen.select("node", F.explode("links").alias("b")).where("node <> b").select(F.col("node").alias("a"), "b"))
        links = found[1]
        for more in found[2:]:
            links = links.union(more)
        roots = components(links)
        placed = left.select("region", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        main = placed.groupBy("region", "root").agg(F.count("*").alias("k")).groupBy("region").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
        placed = placed.join(main, "region").join(chosen, ["region", "node"], "left_anti")  # a pivot's links are all known
        at = materialize(seen.select("region", "node", "far").join(placed.select("region", "node", (F.col("root") != F.col("main")).alias("outside")), ["region", "node"]))
        near = F.array_min("far")
        window = at.where("outside").groupBy("region", F.array_position("far", near).cast("int").alias("p")).agg(F.min(near).alias("lo"), F.max(near).alias("hi"))
        window = window.groupBy("region").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("cells"))  # k a region at most
        inside = F.exists("cells", lambda c: F.element_at("far", c["p"]).between(c["lo"] - NEAR - 1e-9, c["hi"] + NEAR + 1e-9))
        keep = at.join(window, "region").where(inside).select("region", "node", "outside")
        left = materialize(left.drop("outside", "m").join(keep, ["region", "node"]))
        count = materialize(measure(left), 0)
        found.append(by_task(left.join(count.where(fits).select("region"), "region").select(SETS)))
        left = left.join(count.where(f"not ({fits})").select("region", "m"), "region")
        k *= 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    first = materialize(nodes(documents))
    docs = first.where("kind = 0").select("doc_id", "node", "n", "bins")
    rows, shingles = docs.agg(F.count("*"), F.sum("n")).first()
    hot = first.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(f"n >= {HOT_TIMES}").orderBy(F.desc("n"), "node").limit(HOT_MAX)
    hot = np.sort(np.array([r[0] for r in hot.select("node").collect()], np.int64).view(_U))
    dealt = prefixes(documents, hot).repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "node")
    met = materialize(dealt.mapInPandas(trimmed(_meetings), "kind int, a long, b long"))
    one = docs.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bins").alias("bins"), F.min("doc_id").alias("doc_id"))
    one = materialize(one, rows)
    groups = met.where("kind = 0").select("a", "b").distinct().join(one.select(F.col("node").alias("b"), "n", "bins"), "b")
    ties = groups.repartition("a").sortWithinPartitions("a", "n", "b").mapInPandas(trimmed(_ties), "a long, b long")
    spots = met.where("kind = 2").distinct()
    heads = spots.join(spots.groupBy("a").agg(F.min("b").alias("m")), "a").select(F.col("m").alias("a"), "b")
    edges = ties.union(met.where("kind = 1").select("a", "b")).union(heads)
    regions = components(edges).select("node", F.col("root").alias("region"))
    release(met)
    need = materialize(regions.join(one, "node").select("node", "region", F.col("doc_id").alias("need_id")), rows)

    def load(batches):
        for pdf, sets in _sets(batches):
            ids = np.array([node_of(s) for s in sets], np.int64)
            ok = np.flatnonzero(ids == pdf["node"].to_numpy())
            yield pd.DataFrame({"region": pdf["region"].to_numpy()[ok], "node": ids[ok], "n": [len(sets[k]) for k in ok], "shingles": [sets[k].tobytes() for k in ok]})

    texts = documents.select("doc_id", "text").join(need.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("need_id"))).select("text", "node", "region")
    sets = materialize(texts.mapInPandas(trimmed(load), "region long, node long, n long, shingles binary").dropDuplicates(["node"]))
    release(need)
    roots = components(region_links(sets))
    release(sets)
    low = roots.join(one.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = roots.join(low, "root").select("node", "component_id")
    alone = one.select("node", F.col("doc_id").alias("own_id"))
    label = alone.join(label, "node", "left").select("node", F.coalesce("component_id", "own_id").alias("component_id"))
    return docs.join(label, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component: its smallest doc_id, a null one last. Rows of equal id and text count once; others of that id are their own documents."""
    name = fresh(documents, "row_key")
    keyed = documents.withColumn(name, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    groups = classes(keyed.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").dropDuplicates(["key"])
    ids = keyed.select(F.col(name).alias("key"), "doc_id").groupBy("key").agg(F.first("doc_id").alias("doc_id")).join(groups, "key")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    keep = ids.groupBy("component_id").agg(F.min_by("key", first).alias(name)).select(name)
    rows = keyed.join(keep.hint("shuffle_hash"), name, "left_semi").dropDuplicates([name])
    return rows.select([F.col(f"`{c}`") for c in documents.columns])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
