"""Source divergence, Merkle manifest and token counts: against SQL, plain formulas and the library."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from sensorloom.llm import byte_bpe, merkle_manifest as M, source_divergence as D, token_counts as T

from ..compare import connect, same

SF = "/root/testdata/sf0.001"
BIG = 1 << 60
MIXED = [
    (BIG + 1, "Alpha beta ALPHA gamma é漢 delta", "en", "a"), (BIG + 3, "alpha beta beta", "en", "b"), (None, "alpha Beta gamma", "en", "c"), (None, "alpha é漢 gamma", "en", None),
    (4, "beta alpha", "en", "a"), (4, "beta alpha", "en", "a"), (7, None, "en", "empty"), (8, "123 --", None, "a"), (9, "alpha alpha alpha", None, None), (10, "beta", "", ""), (10, "other", "", ""),
    (11, "alpha " * 3000, "fr", "a"), (12, "Alpha", "fr", "b"), (13, "alpha", "fr", "c"), (14, "solo", "xx", "one"),
]


@pytest.fixture
def own(docs):
    """Documents of (doc_id, text, lang, source)."""
    return lambda rows: docs([(i, t, (lang, source)) for i, t, lang, source in rows])


def tables(df):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return con


def test_divergence_equals_sql_on_nulls_ties_and_large_ids(own, edge):
    for df in (own(MIXED), edge, own([])):
        same(D.audit(df), tables(df), D.SQL)


def test_divergence_in_small_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE", 3)
    monkeypatch.setattr(D, "BLOCK", 64)
    monkeypatch.setattr(D, "GATHERED", 500)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    same(D.audit(df), connect(SF), D.SQL)


def test_bitmaps_hold_each_term_once_a_group(spark):
    kept = D.kept_terms(D.term_counts(spark.read.parquet(f"{SF}/documents.parquet")))
    maps = D.bitmaps(kept, 64).groupBy("lang", "source").agg({"size": "sum"}).collect()
    assert {(r.lang, r.source): r["sum(size)"] for r in maps} == {(r.lang, r.source): r["count"] for r in kept.groupBy("lang", "source").count().collect()}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(level):
    """Root and each leaf's siblings, with the side of the leaf."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, k in zip(paths, at):
            path.append((level[k ^ 1] if (k ^ 1) < len(level) else None, k & 1))
        level, at = [h(*level[k : k + 2]) for k in range(0, len(level), 2)], [k // 2 for k in at]
    return level[0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: h(*map(field, (r.doc_id, r.source, r.lang, n, r.text)))
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        own = sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars), r) for r in rows if r.lang == x), key=lambda t: t[:3])
        trees[x] = own, *climb([t[2] for t in own])
    root, above = climb([trees[x][1] for x in langs])
    out = []
    for x, up in zip(langs, above):
        own, sub, paths = trees[x]
        for (_, _, mine, r), path in zip(own, paths):
            hit = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            acc = leaf(r, r.n_chars + 1) if hit else mine
            for s, right in path + up:
                acc = h(acc) if s is None else h(s, acc) if right else h(acc, s)
            out.append((r.doc_id, mine, sub, root, h(*[s for s, _ in path + up if s]), acc, acc == root))
    return out


ORDER = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"


def shown(df):
    return sorted((tuple(r) for r in df.select(*ORDER).collect()), key=str)


@pytest.mark.parametrize("step, broadcast", [(10, 8192), (2, 0), (3, 16)])
def test_manifest_equals_a_plain_tree(own, monkeypatch, step, broadcast):
    monkeypatch.setattr(M, "STEP", step)
    monkeypatch.setattr(M, "BROADCAST", broadcast)
    rows = MIXED + [(k, f"text {k}", "de", "s") for k in range(100, 137)] + [(k * 3, f"more {k}", f"l{k % 5}", None) for k in range(40)]
    df = own(rows)
    assert shown(M.manifest(df)) == sorted(plain_manifest(df.collect()), key=str)


def test_manifest_equals_sql_on_edges(own, edge):
    for df in (edge, own(MIXED), own([])):
        same(M.manifest(df).drop("proof"), tables(df), M.SQL)


def test_manifest_detects_each_change_and_one_leaf_verifies(own):
    one = M.manifest(own([(1, "a", "en", "s")])).first()
    assert one.leaf == one.subroot == one.root and one.proof == [] and one.verified
    base = [(k, f"t{k}", "en", "s") for k in range(20)]
    root = M.manifest(own(base)).first().root
    for changed in (base[1:], base + [base[3]], [(0, "t0.", "en", "s")] + base[1:], [(0, "t0", None, "s")] + base[1:]):
        assert M.manifest(own(changed)).first().root != root


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_file())


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark, library):
    rng = np.random.default_rng(3)
    letters = [*"ab's'tre'll ve \n\t  ''.,!12 ½é漢  　🙂$_\0Ᲊ\U00010d40", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(4000)] + ["x" * 20000, "ab" * 9999, " " * 5000, "漢" * 3000, "<|endoftext|>" * 3, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100000 as doc_id", "text"))
    rows, texts = T.count(df, T.default_file()).collect(), {r.doc_id: r.text or "" for r in df.collect()}
    assert len(rows) == len(texts)
    for r, n in zip(rows, lengths(library, [texts[r.doc_id] for r in rows])):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > T.LIMIT) and r.n_whole <= n


def test_proven_tokens_are_just_those_the_library_keeps_whole(spark, library):
    vocab = T.vocabulary(T.default_file())
    texts = [t for t in map(T._decoded, vocab.strings) if t]
    want = {t for t, n in zip(texts, lengths(library, texts)) if n == 1}
    assert {r.token for r in T.proven_tokens(spark, T.default_file()).collect()} == want


def test_count_edges_and_large_ids(own, edge, library):
    path = T.default_file()
    for df in (edge, own(MIXED)):
        texts = [r.text or "" for r in df.collect()]
        want = sorted(zip([str(r.doc_id) for r in df.collect()], lengths(library, texts)))
        assert sorted((str(r.doc_id), r.n_tokens) for r in T.count(df, path).collect()) == want
    assert T.count(own([]), path).count() == 0


def test_a_small_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(T, "CACHE", 3)
    texts = ["zqxj wvkp qqzz jjxx zqxj"] * 3 + ["y" * 400]
    assert T.Sizes({}, T.vocabulary(T.default_file())).of(texts)[0].tolist() == lengths(library, texts)


def test_classes_of_new_letters_and_numbers():
    table = byte_bpe.class_table()
    assert (table[0x1C89], table[0x10D40], table[0x1CCF9], table[0x41]) == (byte_bpe.LETTER, byte_bpe.NUMBER, byte_bpe.NUMBER, byte_bpe.LETTER)
