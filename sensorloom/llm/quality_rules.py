"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements
and one bit per failed rule. ``apply_policy`` decides from the bits alone, so a
new policy version needs no second pass over texts; ``ablate`` counts, from the
distinct masks, what each rule of a policy removes by itself.

Defined results: null and empty texts have no words, zero measurements, and
fail ``few_words``. Repeated rows are judged alike, an empty table gives an
empty result, columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, let, read, words

#: Bit k of the mask is set if rule k fails. Integer comparisons on the measurements.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
BASE = ("few_words", "repeated_words")
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "dup_lines", "word_length")}
WINDOW = 8


def mask_of(rules) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def _repeated(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; by sorting, so long texts stay n log n."""

    def windows(h):
        at = F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))
        return F.transform(at, lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))

    def covered(wins):
        return let(F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: let(F.size(s) - 1, lambda last: let(
            F.sort_array(F.transform(
                F.filter(s, lambda x, k: (F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]).otherwise(False)) | (F.when(k < last, F.get(s, k + 1)["h"] == x["h"]).otherwise(False))),
                lambda x: x["i"])),
            lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))))

    once = lambda h: F.when(F.size(h) > WINDOW, let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))).otherwise(0)
    return let(hashes, once).cast("long")


def ledger(documents: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, the bitmask of failed rules."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("t", "\n", -1), lambda s: s.rlike(f"[^{SPACE}]"))
    d = (
        documents.select("doc_id", text.alias("t"))
        .select("doc_id", "t", words(F.col("t")).alias("w"), lines.alias("ln"))
        .select(
            "doc_id",
            F.size("w").cast("long").alias("n_words"),
            F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            F.size("ln").cast("long").alias("n_lines"),
            (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
            _repeated(F.transform("w", lambda x: F.xxhash64(x))).alias("n_repeat_words"),
        )
    )
    bits = " | ".join(f"(case when {rule} then {1 << k} else 0 end)" for k, rule in enumerate(RULES.values()))
    return d.withColumn("failed", F.expr(bits).cast("long"))


def apply_policy(led: DataFrame, rules) -> DataFrame:
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(rules))) == 0)


def ablate(led: DataFrame, rules) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it is left out."""
    whole, names = mask_of(rules), list(RULES)
    masks = led.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("m")).agg(F.count("*").alias("n"))  # at most 2^rules rows
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in rules]))
    rows = masks.select("m", "n", each.alias("r")).select("m", "n", "r.*")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    return rows.groupBy("rule").agg(
        some(F.col("m").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        some(F.col("m") == F.col("bit")).alias("n_only"),
        some((F.col("m") == 0) | (F.col("m") == F.col("bit"))).alias("n_kept_without"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(read(spark, sf_dir, "documents")), POLICIES["v1"])
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(mask_of(BASE))) != 0).alias("base_failed"), "kept", "n_lines", "failed",
    )


SQL = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] ln from d),
g as (select rid, unnest(range(1, len(ws) - {WINDOW - 2})) i, ws from w where len(ws) >= {WINDOW}),
h as (select rid, i, count(*) over (partition by rid, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) n from g),
r as (select rid, count(distinct i + k) n_repeat from h, range({WINDOW}) x(k) where n > 1 group by rid),
m as (select doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(ln)::bigint n_lines,
  (len(ln) - len(list_distinct(ln)))::bigint n_dup_lines, coalesce(n_repeat, 0)::bigint n_repeat_words
  from w left join r using (rid)),
f as (select *, ({' + '.join(f'case when {rule} then {1 << k} else 0 end' for k, rule in enumerate(RULES.values()))})::bigint failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask_of(BASE)}) <> 0 base_failed, (failed & {mask_of(POLICIES['v1'])}) = 0 kept, n_lines, failed from f
"""
