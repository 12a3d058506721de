"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, cut further at every sentence mark, so that cuts
move with the content and texts of few lines have several) are hashed to 64
bits. A paragraph of over ``RUN`` characters is cut at places that its own
characters choose: certain pairs of Latin characters and certain other
characters; a piece of it that is still over four times ``RUN`` at every space,
and what is then still over it at every character. (Java's look-behind does not count
characters beyond U+FFFF as one; runs of them may stay whole.)
Each digest enters one cell of each of three subtables: a cell holds a count,
the xor of its digests and the xor of their check hashes. Sketches of two
versions subtract cell by cell; what both hold cancels, and peeling cells that
hold a single digest recovers the differing digests. A sketch has ``CELLS``
cells; a subtraction that does not peel to nothing is retried larger: the
digests are dealt over as many small sketches as hold ``LOAD`` digests each, and a
part that still fails over one four times as large. Parts that fail again are
compared digest by digest, so the likeness (the Jaccard similarity of the
digest sets, 1 for two empty texts) is always exact.

Only DataFrame expressions run. The next document in doc_id order comes from
ranges of doc_id: their bounds are approximate quantiles that occur in the
data, so each range's first document is known and is also sent to the range
before it. Texts are shuffled once; the sketches need no further shuffle.

Defined results: null texts are empty. Null doc_ids stand last; rows of equal
doc_id are ordered by a hash of the text. A single document is its own next
one. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import let, read

TABLES, WIDTH, ROUNDS = 3, 8, 7
#: Retried parts: cells a table, digests and peeling rounds.
SMALL, LOAD, SMALL_ROUNDS = 4, 4, 3
CELLS = TABLES * WIDTH
RUN = 256
CUT = r"\n+|(?<=[.!?;:])\x20+"
#: Of scripts beyond Latin-1, about one character of 32 starts a piece of a long paragraph.
_OTHER = "".join(map(chr, range(0x10E, 0x3400, 32))) + "".join(f"{chr(k)}-{chr(k + 31)}" for k in [*range(0x3400, 0xD800, 1024), *range(0xF900, 0x20000, 1024)])
LONG = ((RUN, rf"(?<=[aA-D01])(?=[\x20rN-Q45])|(?<=[^\x00-\xff])(?=[{_OTHER}])"), (4 * RUN, r"\x20+"), (4 * RUN, r"(?<=.)(?=.)"))
RANGE_ROWS, MAX_RANGES = 1000, 20_000


def _cut_long(pieces, how: tuple[int, str]) -> Column:
    """The pieces, those over a number of characters cut by a pattern."""
    most, pattern = how
    long = lambda p: F.length(p) > most
    cut = lambda p: F.when(long(p), F.split(p, pattern)).otherwise(F.array(p))
    return let(pieces, lambda x: F.when(F.exists(x, long), F.flatten(F.transform(x, cut))).otherwise(x))


def paragraphs(text) -> Column:
    """The pieces of a text that are hashed; empty ones are among them."""
    return reduce(_cut_long, LONG, F.split(text, CUT))


def digests(text) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    return F.array_distinct(F.transform(F.filter(paragraphs(text), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _empty() -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("n"), zero.alias("k"), zero.alias("c"))


def sketch(keys: Column, width: int = WIDTH) -> Column:
    """Array of TABLES * width cells (n, k, c)."""

    def table(j):
        slot = lambda h: F.shiftright(h, 10 * j).bitwiseAND(F.lit(width - 1))
        put = lambda s, h: F.struct((s["n"] + 1).alias("n"), s["k"].bitwiseXOR(h).alias("k"), s["c"].bitwiseXOR(_check(h)).alias("c"))
        at = F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")
        return F.transform(at, lambda i: F.aggregate(keys, _empty(), lambda s, h: F.when(slot(h) == i, put(s, h)).otherwise(s)))

    return F.concat(*[table(j) for j in range(TABLES)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, width: int = WIDTH, rounds: int = ROUNDS) -> Column:
    """Number of digests recovered from a difference; null if cells are left."""

    def one_round(state, _):
        single = F.filter(state["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (_check(c["k"]) == c["c"]))
        pure = F.array_distinct(F.transform(single, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))

        def strip(found):
            def cell(c, i):
                table = F.floor(i / width).cast("int")
                mine = F.filter(found, lambda q: F.call_function("shiftright", q["k"], table * 10).bitwiseAND(F.lit(width - 1)) == i - table * width)
                drop = lambda s, q: F.struct((s["n"] - q["n"]).alias("n"), s["k"].bitwiseXOR(q["k"]).alias("k"), s["c"].bitwiseXOR(_check(q["k"])).alias("c"))
                return F.aggregate(mine, c, drop)

            return F.when(F.size(found) == 0, state).otherwise(
                F.struct(F.transform(state["cells"], cell).alias("cells"), (state["d"] + F.size(found)).alias("d")))

        return let(pure, strip)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("d"))
    clean = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round, lambda s: F.when(clean(s), s["d"]))


def _difference(signed: Column, width: int) -> Column:
    """The subtracted sketch of signed digests (k, n): by linearity, one pass over both sides."""
    slot = lambda x, j: F.shiftright(x["k"], 10 * j).bitwiseAND(F.lit(width - 1)).alias(f"s{j}")
    placed = F.transform(signed, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), _check(x["k"]).alias("c"), *[slot(x, j) for j in range(TABLES)]))

    def table(j, y):
        put = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), s["k"].bitwiseXOR(x["k"]).alias("k"), s["c"].bitwiseXOR(x["c"]).alias("c"))
        at = F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")
        return F.transform(at, lambda i: F.aggregate(F.filter(y, lambda x: x[f"s{j}"] == i), _empty(), put))

    return let(placed, lambda y: F.concat(*[table(j, y) for j in range(TABLES)]))


def _part(signed: Column) -> Column:
    """Differing digests of a small part, by sketches of rising size and then directly."""
    side = lambda n: F.transform(F.filter(signed, lambda x: x["n"] == n), lambda x: x["k"])
    direct = F.size(signed) - 2 * F.size(F.array_intersect(side(1), side(-1)))
    go = lambda w: peel(_difference(signed, w), w, SMALL_ROUNDS)
    return F.coalesce(go(SMALL), go(4 * SMALL), direct)


def _retry(a: Column, b: Column) -> Column:
    """The larger sketch: both sides' digests in one order, dealt over sketches of about ``LOAD`` neighbours each; equal ones stay together."""
    give = lambda keys, n: F.transform(keys, lambda h: F.struct(h.alias("k"), F.lit(n).cast("long").alias("n")))

    def dealt(x):
        key = lambda i: F.get(x, i)["k"]
        start = lambda i: F.when((i > 0) & (key(i * LOAD) == key(i * LOAD - 1)), i * LOAD + 1).otherwise(i * LOAD)
        part = lambda i: let(start(i), lambda s: F.slice(x, s + 1, F.least(start(i + 1), F.size(x)) - s))
        parts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / LOAD).cast("int"))
        return F.aggregate(F.transform(parts, lambda i: let(part(i), _part)), F.lit(0), lambda s, v: s + v)

    return let(F.sort_array(F.concat(give(a, 1), give(b, -1))), lambda x: F.when(F.size(x) == 0, 0).otherwise(dealt(x)))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Jaccard similarity of two digest sets from the peeled difference of their sketches."""
    d = F.coalesce(peel(subtract(cells_a, cells_b)), _retry(a, b))
    both = F.size(a) + F.size(b)
    return let(d, lambda x: F.when(both == 0, F.lit(1.0)).otherwise((both - x) / (both + x)))


def show(cells: Column) -> Column:
    """Cells as fixed-width hexadecimal text."""
    cell = lambda c: F.concat(F.lpad(F.hex(c["n"]), 6, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["c"]), 16, "0"))
    return F.concat(F.lit(f"iblt{CELLS}:"), F.array_join(F.transform(cells, cell), ""))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, t and nxt: each text and the next document's in doc_id order, the first's after the last."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    n, first = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    bounds = []
    if n:
        ranges = int(min(max(n // RANGE_ROWS, 1), MAX_RANGES))
        at = F.from_json(F.lit(json.dumps([k / (ranges + 1) for k in range(1, ranges + 1)])), "array<double>")
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", at, F.lit(10 * ranges))).first()[0]) - {first})
    starts = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = max(len(bounds), 1).bit_length()
    # binary search: how many bounds are at most doc_id
    halve = lambda p, k: F.when((p + k <= len(bounds)) & (F.get(starts, (p + k - 1).cast("int")) <= F.col("doc_id")), p + k).otherwise(p)
    jumps = F.array(*[F.lit(1 << s) for s in range(steps, -1, -1)])
    last = len(bounds)
    home = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.aggregate(jumps, F.lit(0), halve))
    place = lambda kind, bucket: F.struct(F.lit(kind).alias("kind"), bucket.alias("bucket"))
    lead_in = F.when((F.col("home") > 0) & (F.get(starts, F.col("home") - 1) == F.col("doc_id")), place(1, F.col("home") - 1))
    wrap = F.when(F.col("doc_id").eqNullSafe(F.lit(first)), place(2, F.lit(last)))
    sent = docs.withColumn("home", home).withColumn("at", F.explode(F.array_compact(F.array(place(0, F.col("home")), lead_in, wrap))))
    order = Window.partitionBy("bucket").orderBy("kind", F.col("doc_id").isNull(), "doc_id", F.xxhash64("t"))
    return (
        sent.select("doc_id", "t", "at.kind", "at.bucket").withColumn("nxt", F.lead("t").over(order))
        .where("kind = 0").select("doc_id", "t", "nxt")
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    n = F.length("t")
    k = F.floor(n / 4).cast("int")
    x = with_next(documents).select("doc_id", "t", "nxt", F.concat(F.substring("t", F.lit(1), n - k), F.substring("nxt", F.lit(1), k)).alias("e"))
    x = x.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("t")).alias("a"), digests(F.col("e")).alias("b"), digests(F.col("nxt")).alias("c"),
    )
    x = x.select("*", sketch(F.col("a")).alias("ca"), sketch(F.col("b")).alias("cb"), sketch(F.col("c")).alias("cc"))
    near = lambda p, q: likeness(F.col(p), F.col(q), F.col("c" + p), F.col("c" + q))
    return x.select(
        "doc_id", "n_chars", "edited_sha256", show(F.col("ca")).alias("fingerprint"), show(F.col("cb")).alias("edited_fingerprint"),
        near("a", "b").alias("near_edited"), near("a", "c").alias("near_next"),
    )


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
