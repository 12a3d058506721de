"""64-bit ids beside NULLs keep all their digits in every operator that sends rows to Python."""

import datetime

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import byte_bpe, html_extract, language_id, ngram_jaccard, secret_scan

SF = "/root/testdata/sf0.001"
BIG = 1 << 60
IDS = [BIG + 1, None, BIG + 3, None, BIG + 5]


@pytest.fixture
def wide(spark):
    """Documents with large ids beside NULLs, and columns of types that pandas does not keep."""
    day = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(i, f"text number {k} token=abcdefgh{k} of this table", "en", "s", None if k % 2 else BIG + k, None if k % 2 else True, day, None if k else 0.5) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, flag boolean, at timestamp, weight double").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=lambda v: v or 0)


WANT = sorted(IDS, key=lambda v: v or 0)


def test_operators_return_the_ids_they_got(spark, wide):
    model = language_id.train(language_id.labelled_sample(spark.read.parquet(f"{SF}/documents.parquet")))
    assert ids(secret_scan.secrets(wide)) == WANT
    assert ids(byte_bpe.encode(wide, byte_bpe.default_ranks())) == WANT
    assert ids(language_id.predict(wide, model)) == WANT
    pages = wide.select(F.col("doc_id").alias("page_id"), F.lit("http://h.org/a").alias("url"), F.concat(F.lit("<html><body><article><p>"), "text", F.lit("</p></article></body></html>")).alias("html"))
    assert ids(html_extract.main_text(pages), "page_id") == WANT


def test_components_name_documents_that_exist(spark):
    texts = ["one two three four five six seven", "another text that has its own words here", None]
    df = spark.createDataFrame([(BIG + 1, texts[0]), (BIG + 3, texts[1]), (None, "a text of a row without an id at all"), (BIG + 7, texts[0])], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.classes(df).collect()}
    assert (got[BIG + 1], got[BIG + 3], got[BIG + 7]) == (BIG + 1, BIG + 3, BIG + 1)


def test_stages_keep_all_other_columns_as_they_are(spark, wide):
    before = {r.text.split()[2]: r for r in wide.collect()}
    for r in secret_scan.redacted(wide).collect():
        was = before[r.text.split()[2]]
        assert r.text == was.text.replace("token=abcdefgh" + r.text.split()[2], "<secret>")
        assert (r.doc_id, r.flag, r["at"], r.weight, r.n_chars) == (was.doc_id, was.flag, was["at"], was.weight, len(r.text))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") + BIG)).withColumn("other", F.when(F.col("n_chars") % 2 == 0, F.lit(BIG + 1)))
    model = language_id.train(language_id.labelled_sample(docs))
    kept = language_id.keep_accepted(docs.coalesce(1), model)
    assert kept.schema == docs.schema and kept.subtract(docs).count() == 0 and kept.count() > 0.9 * docs.count()


def test_the_pipeline_names_documents_that_exist(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, 2 * F.col("doc_id") + BIG + 1))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    known, got = set(ids(docs)), set(ids(corpus_pipeline.run(spark, str(tmp_path))))
    assert got <= known and len(got) > 100
