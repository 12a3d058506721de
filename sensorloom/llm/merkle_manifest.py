"""Merkle manifest of a dataset, with proofs by pointer jumping.

``leaves`` hashes every row. ``numbered`` sorts them by range, so that a row's
place in its tree is its place in its partition plus the counts of earlier ones.
``forest`` builds all trees ``STEP`` levels at a time: 2^STEP neighbours meet in
one row, which holds their whole subtree. Every node then knows its sibling, a
segment of one level towards its ancestor; ``proofs`` joins the nodes with
themselves, doubling the distance d: nodes at levels divisible by 2d append the
segment of their ancestor d levels up, until every leaf's segment ends at the
root. The trees' roots are the leaves of one more tree, built by the same steps.

An ancestor d levels up is met by 2^d nodes. A round has at most 3 N / 2^d
ancestors (a tree of that height has more than 2^d leaves); where this is at most
``BROADCAST`` they are broadcast, else no ancestor is met by more than 3 /
BROADCAST of the nodes, and the join shuffles evenly.

Defined results: null fields hash as '-'; a null lang is a tree of its own before
all others, apart from ''. Null doc_ids come first; equal doc_ids stand in order
of their leaves, and repeated rows have a leaf each. A tree of one leaf has that
leaf as root and an empty proof. An empty table gives an empty result, columns
other than the five hashed ones are ignored. Texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize, read, release

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels built in one row, and nodes (of at most 64 digests each) that may be broadcast.
STEP, BROADCAST = 10, 8192
TAMPER = 7


def hexed(x) -> Column:
    return F.lower(F.hex(x))


def digest(*parts: Column) -> Column:
    """H of digests, as binary: sha256 of their hex text, those that are NULL left out."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(hexed(p), F.lit("")) for p in parts]), 256))


def leaf(n_chars: Column | None = None) -> Column:
    """H of a row's fields, each with its length, so that no two rows share an input; ``n_chars`` may stand in for its column."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    columns = [(n_chars if c == "n_chars" and n_chars is not None else F.col(c)).cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(text, columns)), 256))


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, tree (a key of lang that sorts null first), digest, and the digest of the tampered row where it differs."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    tampered = F.when(hit & F.col("n_chars").isNotNull(), leaf(F.col("n_chars").cast("long") + 1))
    return documents.select("doc_id", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("tree"), leaf().alias("digest"), tampered.alias("tampered"))


def numbered(items: DataFrame, order) -> DataFrame:
    """Adds ``i``, the place from 0 in the row's tree by ``order``, and ``n``, the tree's size; ties are dealt over ranges by row."""
    d = items.withColumn("_tie", F.monotonically_increasing_id())
    d = d.repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    d = materialize(d).withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    w = Window.partitionBy("tree")
    # a row for each range and tree in it
    ranges = d.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    ranges = ranges.select("tree", "_part", (F.sum("_k").over(w.orderBy("_part")) - F.col("_k") - F.col("_first")).alias("_shift"), F.sum("_k").over(w).alias("n"))
    return d.join(materialize(ranges, 1), ["tree", "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_id", "_part", "_at", "_shift")


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _up(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.call_function("div", F.size(nodes) - 1, F.lit(2)).cast("int"))
    return F.transform(pairs, lambda k: digest(F.get(nodes, 2 * k), F.get(nodes, 2 * k + 1)))


def forest(items: DataFrame, top: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes (tree, level, i, seg) below the roots, ``seg`` an array of their sibling (NULL if none); (tree, root); tables to release.

    ``items`` has tree, i, n, digest; ``top`` is the greatest height.
    """
    now = items.select("tree", "i", "n", "digest")
    roots = now.where("n = 1").select("tree", F.col("digest").alias("root"))
    nodes, tables = None, []
    for done in range(0, top, STEP):
        levels = F.least(F.lit(STEP), height(F.col("n")) - done)
        c = now.where(height(F.col("n")) > done).groupBy("tree", "n", F.shiftright("i", STEP).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("d"))
        stack = F.aggregate(F.sequence(F.lit(1), levels), F.array(F.col("d.digest")), lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1)))))
        c = materialize(c.select("tree", "n", "chunk", levels.alias("levels"), stack.alias("stack")))
        tables.append(c)
        each = c.select("tree", "chunk", F.posexplode(F.slice("stack", F.lit(1), F.col("levels"))).alias("at", "row")).select("tree", "chunk", "at", "row", F.posexplode("row").alias("k", "_"))
        each = each.select("tree", (F.col("at") + done).alias("level"), (F.call_function("shiftleft", F.col("chunk"), F.lit(STEP) - F.col("at")) + F.col("k")).alias("i"),
                           F.array(F.get("row", F.col("k").bitwiseXOR(F.lit(1)))).alias("seg"))
        nodes = each if nodes is None else nodes.union(each)
        now = c.select("tree", F.col("chunk").alias("i"), "n", F.get(F.element_at("stack", -1), F.lit(0)).alias("digest"))
        roots = roots.union(now.where(height(F.col("n")) <= done + STEP).select("tree", F.col("digest").alias("root")))
    return nodes, roots, tables


def proofs(items: DataFrame, nodes: DataFrame | None, total: int, top: int) -> tuple[DataFrame, list[DataFrame]]:
    """``items`` with ``seg``, the siblings from leaf to root, a NULL for a level where the node stands alone."""
    none = F.array().cast("array<binary>")
    if nodes is None:
        return items.withColumn("seg", none), []
    level0 = nodes.where("level = 0").drop("level")
    now = items.join(level0, ["tree", "i"], "left").withColumn("level", F.lit(0)).withColumn("seg", F.coalesce("seg", none))
    now = now.unionByName(nodes.where("level > 0"), allowMissingColumns=True)
    d, old = 1, []
    while d < top:
        now = materialize(now)
        release(*old)
        old = [now]
        upper = now.where(F.col("level") % (2 * d) == d).select("tree", (F.col("level") - d).alias("level"), F.col("i").alias("up"), F.col("seg").alias("more"))
        if 3 * total <= BROADCAST << d:
            upper = F.broadcast(upper)
        lower = now.where(F.col("level") % (2 * d) == 0).withColumn("up", F.shiftright("i", d))
        now = lower.join(upper, ["tree", "level", "up"], "left").withColumn("seg", F.concat("seg", F.coalesce("more", none))).drop("up", "more")
        d *= 2
    return now.where("level = 0").drop("level"), old


def merkle(items: DataFrame, order) -> tuple[DataFrame, DataFrame]:
    """``items`` (tree, digest, more) with i, n and seg; and (tree, root)."""
    placed = numbered(items, order)
    size = placed.agg(F.count("*").alias("total"), F.coalesce(F.max(height(F.col("n"))), F.lit(0)).alias("top")).first()
    nodes, roots, tables = forest(placed, size.top)
    roots = materialize(roots, 1)
    out, old = proofs(placed, nodes, size.total, size.top)
    if old:
        release(*tables)
    return out, roots


def fold(start: Column, seg: Column, i: Column) -> Column:
    """The root that the hex digest ``start`` of leaf ``i`` gives with the siblings ``seg``."""
    steps = F.transform(seg, lambda s, k: F.struct(hexed(s).alias("s"), (F.call_function("shiftright", i, k).bitwiseAND(F.lit(1)) == 1).alias("right")))
    return F.aggregate(steps, start, lambda acc, x: F.sha2(F.when(x["s"].isNull(), acc).when(x["right"], F.concat(x["s"], acc)).otherwise(F.concat(acc, x["s"])), 256))


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof itself (siblings in hex, NULL for none)."""
    rows, roots = merkle(materialize(leaves(documents)), ["doc_id", "digest"])
    upper, root = merkle(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), ["of"])
    # one digest, or none of an empty table
    found = root.first()
    root = F.lit(bytes(found.root).hex() if found else None).cast("string")
    upper = materialize(upper.select(F.col("of").alias("tree"), F.col("i").alias("at"), F.col("seg").alias("above"), F.col("digest").alias("subroot")), 1)
    d = rows.join(upper, "tree")
    path = F.concat("seg", "above")
    d = d.select("doc_id", hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), root.alias("root"), F.transform(path, hexed).alias("proof"),
                 fold(fold(hexed(F.coalesce("tampered", "digest")), F.col("seg"), F.col("i")), F.col("above"), F.col("at")).alias("folded_root"))
    return d.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "proof")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents")).drop("proof")


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::varchar) || ':' || ({x}::varchar), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


# crc32 by its table (reflected polynomial 0xEDB88320), the trees level by level, the fold along a list
SQL = f"""
with recursive crc as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) crc_table),
d as (select row_number() over () rid, doc_id, lang, {_leaf('n_chars')} leaf,
  case when doc_id is not null and xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295) % {TAMPER} = 0
    then {_leaf('(n_chars + 1)')} else {_leaf('n_chars')} end tampered from documents, crc),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 i from d),
tree(l, lang, i, h, n) as (select 0, lang, i, leaf, (count(*) over (partition by lang))::bigint from p
  union all select l + 1, lang, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from tree where n > 1 group by l, lang, i // 2, n),
sub as (select lang, h subroot, row_number() over (order by lang nulls first) - 1 i from tree where n = 1),
up(l, i, h, n) as (select 0, i, subroot, (count(*) over ())::bigint from sub
  union all select l + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from up where n > 1 group by l, i // 2, n),
root as (select h root from up where n = 1),
steps as (select p.rid, t.l, s.h, (p.i >> t.l) & 1 = 1 r from p join tree t on t.lang is not distinct from p.lang and t.i = p.i >> t.l and t.n > 1 left join tree s on s.l = t.l and s.lang is not distinct from t.lang and s.i = xor(t.i, 1)
  union all select p.rid, 1000 + t.l, s.h, (b.i >> t.l) & 1 = 1 from p join sub b on b.lang is not distinct from p.lang join up t on t.i = b.i >> t.l and t.n > 1 left join up s on s.l = t.l and s.i = xor(t.i, 1)),
proof as (select rid, list(struct_pack(h := h, r := r) order by l) s from steps group by rid),
f as (select p.doc_id, p.leaf, b.subroot, root, sha256(coalesce(array_to_string(list_transform(s, lambda x: coalesce(x.h, '')), ''), '')) proof_sha256,
  list_reduce(list_prepend(struct_pack(h := p.tampered, r := false), coalesce(s, [])),
    lambda a, x: struct_pack(h := sha256(case when x.h is null then a.h when x.r then x.h || a.h else a.h || x.h end), r := false)).h folded_root
  from p join sub b on b.lang is not distinct from p.lang cross join root left join proof using (rid))
select *, folded_root = root verified from f
"""
