"""How far the sources of a language drift apart in their words: count-level bitmaps.

``term_counts`` counts terms by (lang, source) and ``kept_terms`` keeps those in
enough documents. ``bitmaps`` stores, for every (group, count), the set of terms
with just that count as words of 64 bits, in blocks of terms whose counts are of
like size, so that rare terms, nearly all of a vocabulary, lie in a few dense
sets. ``pair_divergence`` ANDs the sets of two groups and counts bits: the joint
cells of a pair. A cell's size times f is a sum over all its terms at once. Terms
that one or both groups lack are never met: their cells follow by complement,

    sum f = V f(0,0) + sum_a n(a) (f(a,0) - f(0,0)) + sum_b n(b) (f(0,b) - f(0,0))
            + sum_ab n(a,b) (f(a,b) - f(a,0) - f(0,b) + f(0,0)).

A block is cut into tiles of ``TILE`` sources, so a task holds two tiles of one
block however many sources a language has. All arithmetic is on integers.

Defined results: null text, lang and source are ''. A group without terms still
has its pairs (0 where its language keeps no term) and no terms. Repeated rows
count as often as they occur, an empty table gives an empty result, columns other
than text, lang and source are ignored. Texts may be of any length; equal values
rank by item, bytewise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bounded, materialize, read, trimmed

LEAST_DOCS, TOP = 3, 200
#: Terms of a block, and sources of a tile.
BLOCK, TILE = 2048, 64
#: Rows of counts that a task gathers before it sends them on.
GATHERED = 400_000
#: A-Z become a-z, letters and bytes beyond ASCII stay, all else separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _summed(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.rename_columns({"n_sum": "n", "docs_sum": "docs"})


def _batch_counts(b: pa.RecordBatch) -> pa.Table:
    """Occurrences of each term and the documents that have it, by group, of one batch."""
    text = pc.fill_null(b["text"], "").cast(pa.large_string())
    _, ends, data = text.buffers()
    folded = pa.LargeStringArray.from_buffers(len(text), ends, pa.py_buffer((data.to_pybytes() if data else b"").translate(FOLD)), offset=text.offset)
    split = pc.ascii_split_whitespace(folded)
    t = pa.table({"doc": pc.list_parent_indices(split), "term": pc.list_flatten(split).cast(pa.string())})
    t = t.filter(pc.not_equal(t["term"], "")).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    doc = t["doc"]
    t = pa.table({"lang": b["lang"].take(doc), "source": b["source"].take(doc), "term": t["term"], "n": t["count_all"], "docs": pa.array(np.ones(len(t), np.int64))})
    return _summed([t])


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), summed within each task: a group's term has a row a task, not one a document."""

    def run(batches):
        parts, size = [], 0
        for b in batches:
            parts.append(_batch_counts(b))
            size += len(parts[-1])
            if size > GATHERED:
                parts = [_summed(parts)]
                size = len(parts[0])
                if size > GATHERED // 2:
                    yield from parts[0].to_batches(1 << 16)
                    parts, size = [], 0
        if size:
            yield from _summed(parts).to_batches(1 << 16)

    return bounded(documents).select("text", _text("lang"), _text("source")).mapInArrow(trimmed(run), COUNTS)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, head) of the terms in ``least`` documents of a language; ``head`` marks one row of each term.

    One shuffle, by (lang, term), serves both sums.
    """
    w = Window.partitionBy("lang", "term")
    d = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    d = d.select("lang", "source", "term", "n", F.sum("n").over(w).alias("total"), F.sum("docs").over(w).alias("in_docs"), (F.col("source") == F.min("source").over(w)).alias("head"))
    return d.where(F.col("in_docs") >= least).drop("in_docs")


def share(n, total, terms) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact; NULL where no term is kept."""
    big = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (big(n) + 1).cast("decimal(20,0)")
    whole = F.call_function("div", top, F.nullif(big(total) + big(terms), F.lit(0).cast("decimal(20,0)")))
    return 1 + whole


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) of the documents: its total, its zero share p0, V and the total of its language, and its tile."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count_if("head").alias("terms"), F.sum("n").alias("lang_size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    g = documents.select(_text("lang"), _text("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    g = g.select("lang", "source", zero("size"), zero("terms"), zero("lang_size"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    of = F.count("*").over(Window.partitionBy("lang"))
    return g.withColumn("p0", share(F.lit(0), "size", "terms")).withColumn("tile", F.floor(at / TILE)).withColumn("tiles", F.ceil(of / TILE))


def bitmaps(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, scale, block, source, n, size, words): the terms with count ``n`` in a group as (place, 64 bits) words.

    ``scale`` is the magnitude of the term's count in its language; blocks of one
    scale are hash parts of about ``block`` terms, fewer where counts are high and
    levels many. Terms of a block are numbered by their order.
    """
    k = kept.withColumn("scale", F.floor(F.log2(F.col("total").cast("double"))))
    wide = F.expr(f"greatest(64, shiftright({block}, int(greatest(scale - 4, 0))))")
    sizes = materialize(k.where("head").groupBy("lang", "scale").agg(F.count("*").alias("k")).select("lang", "scale", F.ceil(F.col("k") / wide).alias("parts")), 1)
    k = k.join(sizes, ["lang", "scale"]).select("lang", "scale", F.pmod(F.xxhash64("term"), "parts").alias("block"), "source", "n", "term")
    at = F.dense_rank().over(Window.partitionBy("lang", "scale", "block").orderBy("term")) - 1
    k = k.withColumn("at", at).select("lang", "scale", "block", "source", "n", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, at & 63)").alias("bit"))
    words = k.groupBy("lang", "scale", "block", "source", "n", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("lang", "scale", "block", "source", "n").agg(
        F.sum(F.bit_count("bits").cast("long")).alias("size"), F.collect_list(F.struct("word", "bits")).alias("words"))


def _f(p, q):
    return (p - q) ** 2 // q


def _joint(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum over the joint cells of every ordered pair of sources in two tiles of one block."""
    lang, low, high = pdf["lang"].iloc[0], pdf["low"].iloc[0], pdf["high"].iloc[0]
    pdf = pdf.sort_values(["tile", "source"], kind="stable")
    names, own = np.unique(pdf["source"].to_numpy(), return_inverse=True)
    p, p0, tile = (pdf[c].to_numpy(np.int64) for c in ("p", "p0", "tile"))
    places = [np.fromiter((w["word"] for w in ws), np.int64, len(ws)) for ws in pdf["words"]]
    bits = np.zeros((len(pdf), 1 + max(int(x.max()) for x in places)), np.uint64)
    for row, x, ws in zip(bits, places, pdf["words"]):
        row[x] = np.fromiter((w["bits"] for w in ws), np.int64, len(ws)).view(np.uint64)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])  # rows of one source lie together
    after = dict(zip(own[first].tolist(), [*first[1:].tolist(), len(own)]))
    out = np.zeros((len(names), len(names)), np.int64)
    for i in range(len(pdf)):
        a = int(own[i])
        # later sources only; beside a tile's own pairs only those that reach the other tile
        j = after[a] if low == high else max(after[a], int(np.searchsorted(tile, high))) if tile[i] == low else len(own)
        if j >= len(own):
            continue
        live = np.flatnonzero(bits[i])
        cell = np.bitwise_count(bits[i, live] & bits[j:, live]).sum(1, dtype=np.int64)
        hit = np.flatnonzero(cell) + j
        n, b = cell[hit - j], own[hit]
        there = _f(p[i], p[hit]) - _f(p[i], p0[hit]) - _f(p0[i], p[hit]) + _f(p0[i], p0[hit])
        back = _f(p[hit], p[i]) - _f(p[hit], p0[i]) - _f(p0[hit], p[i]) + _f(p0[hit], p0[i])
        np.add.at(out[a], b, n * there)
        np.add.at(out[:, a], b, n * back)
    s, o = np.nonzero(out)
    return pd.DataFrame({"lang": lang, "source": names[s], "item": names[o], "value": out[s, o]})


def pair_divergence(maps: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over all kept terms, for every two sources of a language."""
    g = group.select("lang", "source", "size", "terms", "p0", "tile", "tiles").withColumnRenamed("size", "total")
    rows = maps.join(g, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    mine, other = F.col("tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    tiled = rows.withColumn("other", other).withColumn("low", F.least(mine, "other")).withColumn("high", F.greatest(mine, "other"))
    joint = tiled.select("lang", "scale", "block", "low", "high", "tile", "source", "p", "p0", "words").groupBy("lang", "scale", "block", "low", "high").applyInPandas(
        _joint, "lang string, source string, item string, value long")
    h = g.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "terms")
    zero = distance(F.col("p0"), F.col("q0"))
    none = g.select("lang", "source", "p0").join(h, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("terms") * zero, F.lit(0)).alias("value"))
    levels = rows.groupBy("lang", "source", "p", "p0").agg(F.sum("size").alias("k")).join(h, "lang").where("source <> item")
    lone = levels.groupBy("lang", "source", "item").agg(
        F.sum(F.col("k") * (distance(F.col("p"), F.col("q0")) - zero)).alias("as_source"),
        F.sum(F.col("k") * (distance(F.col("q0"), F.col("p")) - distance(F.col("q0"), F.col("p0")))).alias("as_item"))
    lone = lone.select("lang", F.explode(F.array(
        F.struct("source", "item", F.col("as_source").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("as_item").alias("value")))).alias("r")).select("lang", "r.*")
    return none.unionByName(lone).unionByName(joint).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(kept: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has more of than its language."""
    k = kept.join(group.drop("p0", "tile", "tiles"), ["lang", "source"])
    k = k.select("lang", "source", F.col("term").alias("item"), share("n", "size", "terms").alias("p"), share("total", "lang_size", "terms").alias("q")).where("p > q")
    return k.select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def ranked(parts: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """Rank by value, then item; with ``most``, Spark cuts at that rank in every task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    d = parts.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return d.where(F.col("rank") <= most) if most else d


def audit(documents: DataFrame, top: int = TOP) -> DataFrame:
    kept = materialize(kept_terms(term_counts(documents)))
    group = materialize(groups(documents, kept), 1)
    maps = materialize(bitmaps(kept))
    return ranked(pair_divergence(maps, group), "pair").unionByName(ranked(term_divergence(kept, group), "term", top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = rf"""
with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
c as (select lang, source, term, count(*) n, count(distinct rid) docs from w group by all),
k as (select lang, term, sum(n) total from c group by all having sum(docs) >= {LEAST_DOCS}),
g as (select distinct lang, source from d),
v as (select lang, count(*) v, sum(total) nl from k group by lang),
s as (select c.lang, c.source, sum(n) ng from c join k using (lang, term) group by all),
x as (select g.lang, g.source, k.term, k.total, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(ng, 0) + v) p, 1 + (1000000000::hugeint * (k.total + 1)) // (nl + v) ql
  from g join k on g.lang = k.lang join v on v.lang = g.lang left join s on s.lang = g.lang and s.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
e as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) f from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join e on e.lang = a.lang and e.source = a.source and e.item = b.source
  union all select lang, source, 'term', term, (((p - ql) * (p - ql)) // ql)::bigint from x where n > 0 and p > ql),
q as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r)
select * from q where part = 'pair' or rank <= {TOP}
"""
