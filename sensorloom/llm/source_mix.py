"""Mixing sources to target weights by systematic sampling.

Each source's target is its weight's share of the wanted total, at most
``CAP`` times the source; what is cut off is shared again by weight
(water-filling: one level, found from the sorted capacity-to-weight ratios).
A document of a source is expected ``target / source size`` times. Within the
source, documents stand in the order (size class, slice, size, doc_id); prefix
sums of the expected copies plus one random offset per source emit a copy at
each integer crossed. Ordering by size keeps the taken words near the target.

No source is put into one task: rows are ranked inside (source, size class,
slice) blocks, whose number follows the number of documents; the blocks' counts
are summed up within each size class, and those of the few hundred classes
within the source. Offsets and slices derive from MD5, so that reruns agree.

Defined results: null texts have size 0; null sources are one source that
stands last; sizes of 0 take 0. An empty table gives an empty result; repeated
rows each count. Columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import SPACE, fresh, materialize, read

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"


def targets(sources: DataFrame) -> DataFrame:
    """skey, source_size -> also target. One row a source; only this table is ordered as a whole."""
    order = Window.orderBy("skey")
    by_ratio = Window.orderBy("ratio", "skey")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    x = (
        sources.withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * CAP)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double") * SHARE)
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    )
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x.withColumn("the_level", level).select("skey", "source_size", F.least(F.coalesce(F.col("the_level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def copies(documents: DataFrame, seed: str = SEED, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and n_copies of every document; ``keys`` are columns that are kept and order equal documents."""
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")
    docs = materialize(
        documents.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), text)).alias("slice"), *keys)
        .withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))  # null stands last
        .withColumn("bits", F.length(F.bin("size")).cast("int"))
        .withColumn("cls", F.expr("bits * 32L + shiftright(size * 32L, bits)"))
        .drop("bits")
    )
    digits = max(1, len(f"{docs.count():x}") - 5)  # 16 times the documents, 16 times the slices of a size class
    docs = docs.withColumn("slice", F.substring("slice", 1, digits))
    block = ["skey", "cls", "slice"]
    blocks = docs.groupBy(block).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = blocks.groupBy("skey", "cls").agg(F.sum("n").alias("n")).withColumn("below", before(Window.partitionBy("skey").orderBy("cls"))).drop("n")
    blocks = blocks.withColumn("within", before(Window.partitionBy("skey", "cls").orderBy("slice"))).join(classes, ["skey", "cls"])
    blocks = materialize(blocks.withColumn("ahead", F.col("below") + F.col("within")).drop("below", "within"))
    goals = targets(blocks.groupBy("skey").agg(F.sum("words").alias("source_size")))
    starts = blocks.join(goals, "skey").select(*block, "ahead", "source_size", "target")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), "skey")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    i = F.col("ahead") + F.row_number().over(Window.partitionBy(block).orderBy("size", "doc_id", *keys))
    return (
        docs.join(starts, block).withColumn("u", u).withColumn("rate", rate).withColumn("i", i)
        .withColumn("n_copies", F.expr("cast(floor(u + i * rate) - floor(u + (i - 1) * rate) as bigint)"))
        .select("doc_id", "source", "size", "source_size", "target", "n_copies", *keys)
    )


def mix(documents: DataFrame) -> DataFrame:
    """The mixed documents themselves, each repeated as often as it is taken."""
    key, times, number = (fresh(documents, name) for name in ("row_key", "row_times", "row_number"))
    own = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.withColumn(key, F.xxhash64(*[x for c in own for x in (c.isNull(), c)]))  # rows of one key are equal, so one of them stands for all their copies
    plan = copies(keyed.select("doc_id", "source", "text", F.col(key).alias("row_key")), keys=("row_key",)).where("n_copies > 0")
    plan = plan.groupBy(F.col("row_key").alias(key)).agg(F.sum("n_copies").alias(times))
    rows = keyed.join(plan.hint("shuffle_hash"), key).dropDuplicates([key])
    return rows.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(own)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


SQL = rf"""
with d as (select doc_id, coalesce(text, '') body, coalesce('s' || source, 't') skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
k as (select *, length(bin(size)) bits, substr(md5(coalesce(doc_id::varchar, body)), 1, greatest(1, (select length(to_hex(count(*))) - 5 from d))) slice from d),
c as (select *, bits * 32 + ((size * 32) >> bits) cls from k),
s as (select skey, sum(size)::bigint source_size from d group by skey),
w as (select *, case (row_number() over (order by skey) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end weight, source_size * {CAP}.0::double cap from s),
b as (select *, coalesce(sum(cap) over (order by cap / weight, skey rows between unbounded preceding and 1 preceding), 0) before,
  sum(weight) over (order by cap / weight, skey rows between current row and unbounded following) rest, (sum(source_size) over ())::double * {SHARE}::double total from w),
l as (select arg_min((total - before) / rest, struct_pack(a := cap / weight, b := skey)) lev from b where (total - before) / rest * weight <= cap),
t as (select skey, source_size, least(coalesce(lev * weight, cap), cap) target from b, l),
r as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end rate,
  ('0x' || substr(md5('{SEED}|' || skey), 1, 8))::bigint::double / 4294967296.0::double u,
  row_number() over (partition by skey order by cls, slice, size, doc_id) i from c join t using (skey))
select doc_id, size, source_size, target, (floor(u + i * rate) - floor(u + (i - 1) * rate))::bigint * size as taken from r
"""
