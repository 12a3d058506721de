"""Suffix-array dedup, Jaccard join and the pipeline against brute force, and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from sensorloom.llm import byte_bpe, components, ngram_jaccard, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute_removal(rows):
    seen, out = {}, []
    for doc_id, b in sorted(rows):
        edge = np.zeros(len(b) + 1, int)
        w = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, x in enumerate(w):
            if seen.get(x, doc_id) < doc_id:
                edge[k] += 1
                edge[k + 50] -= 1
        for x in w:
            seen.setdefault(x, doc_id)
        gone = np.cumsum(edge[:-1]) > 0
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_arrays():
    rnd = random.Random(1)
    for k in range(150):
        alphabet = rnd.choice([b"ab", b"abc", bytes(range(1, 256)), b"a"])
        t = bytes(rnd.choice(alphabet) for _ in range(rnd.randint(1, 120))) * rnd.randint(1, 3) + b"\0"
        assert suffix_dedup.suffix_array(np.frombuffer(t, np.uint8)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def planted(n=120):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, rows = prose(30), []
    for k in range(n):
        t = prose(rnd.randint(0, 80))
        if k % 3 == 0:
            t = t + " " + passage[: rnd.randint(20, len(passage))] + " " + prose(5)
        if k % 10 == 9:
            t = rows[-3][1]
        if k % 11 == 10:
            t = rows[-1][1][:-3] + "xyz"
        if k % 17 == 0:
            t = "ab" * rnd.randint(10, 200)
        rows.append((k, t))
    return rows


def test_removals_equal_brute_force(spark, docs, monkeypatch):
    rows = planted() + [(500, None), (501, ""), (502, "é" * 60), (503, "ñ" + "é" * 60), (504, "\0" * 80), (505, "\0" * 90)]
    want = brute_removal([(d, (t or "").encode()) for d, t in rows])
    df = docs(rows)
    assert sorted(tuple(r) for r in suffix_dedup.removals(df).collect()) == want
    monkeypatch.setattr(suffix_dedup, "SHARD", 400)  # anchors that overfill a shard are parted; the result is the same
    assert sorted(tuple(r) for r in suffix_dedup.removals(df).collect()) == want


def test_repeated_blocks_equal_brute_force(docs, monkeypatch):
    """Long near copies, shifted and cut, so that whole blocks repeat; a passage that all documents share."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    base, common, rows = prose(700), prose(25), []
    for k in range(60):
        t = base if k % 2 else prose(rnd.randint(100, 400))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(t))
            t = t[:at] + word() + t[at + rnd.randint(0, 300) :]
        at = rnd.randrange(len(t))
        rows.append((rnd.choice([k, 1000 - k]), t[:at] + common + t[at:]))
    rows += [(2000, "ab" * 2000), (2001, "b" + "ab" * 1500), (2002, "a" * 3000), (2003, base[:1000] + "a" * 2500), (2004, base[40:90]), (2005, base[:49])]
    want = brute_removal([(d, t.encode()) for d, t in rows])
    assert sorted(tuple(r) for r in suffix_dedup.removals(docs(rows)).collect()) == want
    monkeypatch.setattr(suffix_dedup, "CUT_EVERY", 2)
    monkeypatch.setattr(suffix_dedup, "SHARD", 1500)
    assert sorted(tuple(r) for r in suffix_dedup.removals(docs(rows)).collect()) == want


def test_removal_edges(edge):
    assert suffix_dedup.removals(edge).count() == edge.count()
    assert suffix_dedup.removals(edge.limit(0)).count() == 0


def shingles(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    label = {k: k for k in range(len(sets))}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), d), d)
    return {d: (len(s), least[root(k)]) for k, (d, s) in enumerate(sets)}


def near_rows():
    rnd = random.Random(4)
    prose = lambda k: [rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet", "Nunc", "elit", "sed", "quis"]) + str(rnd.randint(0, 300)) for _ in range(k)]
    rows, base = [], prose(120)
    for k in range(150):
        w = list(base) if k % 3 == 0 else prose(rnd.randint(0, 90))
        for _ in range(rnd.randint(0, 6)):
            if w:
                w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 9999)}"
        rows.append((k, " ".join(w)))
    return rows + [(k + 200, t.upper() if k % 2 else t) for k, t in rows[:20]] + [(300, None), (301, ""), (302, "a b"), (303, "A b"), (304, "a b c")]


def test_components_equal_brute_force(spark, docs, monkeypatch):
    rows = near_rows()
    want = brute_components(rows)
    got = lambda: {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.classes(docs(rows)).collect()}
    assert got() == want
    # the same with everything frequent, small batches and rounds of pivots as joins
    monkeypatch.setattr(ngram_jaccard, "HOT_TIMES", 3)
    monkeypatch.setattr(ngram_jaccard, "LOCAL_WORK", 1500)
    monkeypatch.setattr(ngram_jaccard, "PIVOTS", 2)
    monkeypatch.setattr(ngram_jaccard, "MEETING_ROWS", 5)
    monkeypatch.setattr(ngram_jaccard, "TIE_ROWS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keys must meet in any partitioning
    try:
        assert got() == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def drifting(seed, n, step):
    """Sets of 40 that drift away from each other in several chains, so that links form chains and cells have neighbours."""
    rng, sets = np.random.default_rng(seed), []
    heads = [rng.integers(0, 1 << 60, 40) for _ in range(4)]
    for k in range(n):
        s = heads[k % 4].copy()
        s[rng.integers(0, 40, rng.integers(0, step))] = rng.integers(0, 1 << 60)
        heads[k % 4] = s
        sets.append(np.unique(s.astype(np.uint64))[: rng.integers(34, 41)])
    return sets


def region_roots(links, n):
    trees = ngram_jaccard.Forest(n)
    for a, b in links:
        trees.join(a, b)
    return [trees.root(k) for k in range(n)]


def test_regions_of_two_and_of_thousands(monkeypatch):
    import pandas as pd

    def brute(sets):
        held, links = [set(s.tolist()) for s in sets], []
        for i, a in enumerate(held):
            links += [(j, i) for j in range(i) if 100 * len(a & held[j]) >= 80 * len(a | held[j])]
        return region_roots(links, len(sets))

    for seed, n, step in [(0, 2, 1), (1, 2, 9), (2, 3, 3), (3, 60, 5), (4, 200, 4), (5, 200, 8), (6, 1500, 6)]:
        sets = drifting(seed, n, step)
        pdf = pd.DataFrame({"region": 1, "node": range(n), "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]})
        for pivots in (2, 16):
            monkeypatch.setattr(ngram_jaccard, "PIVOTS", pivots)
            got = ngram_jaccard.local_links(pdf.sample(frac=1, random_state=seed))
            assert region_roots(got.itertuples(index=False, name=None), n) == brute(sets)


def test_sorted_batches_keep_groups_whole():
    import pandas as pd

    rng = np.random.default_rng(3)
    for rows in (1, 4, 50):
        key = np.sort(rng.integers(0, 12, 80))
        pdf = pd.DataFrame({"k": key, "v": range(80)})
        cuts = np.sort(rng.integers(0, 80, 9))
        out = list(ngram_jaccard.whole_groups(iter([pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 80])]), ["k"], rows))
        assert pd.concat(out)["v"].tolist() == list(range(80))
        assert sum(len(set(p["k"])) for p in out) == len(set(key))


def test_shingle_hashes_follow_the_words():
    a, b = ngram_jaccard.shingle_sets(["One two  three\tfour five six", "one TWO three four five six"])
    assert a.tolist() == b.tolist() and len(a) == 2
    assert len(ngram_jaccard.shingle_sets(["a b c d e a b c d e"])[0]) == 5


def test_join_edges(edge):
    rows = ngram_jaccard.classes(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[5].component_id == 4
    assert ngram_jaccard.classes(edge.limit(0)).count() == 0


def test_components_of_chains(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_null_ids_and_equal_ids_keep_their_documents(docs):
    from sensorloom.llm import source_mix

    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, prose(1)), (2, prose(1)), (3, prose(3)), (3, prose(4)), (3, prose(4)), (None, prose(1)), (None, prose(5)), (None, prose(6)), (None, prose(6)), (9, None), (10, "")]
    kept = sorted(((r.doc_id, r.text) for r in ngram_jaccard.keep_one(docs(rows)).collect()), key=str)
    assert kept == sorted([(1, prose(1)), (3, prose(3)), (3, prose(4)), (None, prose(5)), (None, prose(6)), (9, None), (10, "")], key=str)
    rows = [(d, t, "en", "s") for d, t in kept] + [(None, prose(6), "en", "s"), (3, "a b", "en", "s")]
    plan = source_mix.copies(docs(rows)).collect()
    got = Counter((r.doc_id, len((r.text or "").split())) for r in source_mix.mix(docs(rows)).collect())
    want = Counter()
    for r in plan:
        want[r.doc_id, r.size] += r.n_copies
    assert got == +want and sum(n for (d, _), n in got.items() if d is None) > 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from sensorloom.llm import secret_scan, source_mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = p.identify_language(spark, docs, SF)
    assert a.columns == docs.columns and a.count() >= 0.98 * docs.count()
    b = p.drop_near_duplicates(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    comp = brute_components(rows)
    assert sorted(r.doc_id for r in b.select("doc_id").collect()) == sorted({c for _, c in comp.values()})
    c = {r.doc_id: r.text for r in p.redact_secrets(spark, docs, SF).collect()}
    cuts = secret_scan.corpus_cuts(docs)
    assert all(c[d] == secret_scan.redact(t, secret_scan.scan(t, cuts)) for d, t in rows)
    m = p.mix_sources(spark, docs, SF)
    n = {r.doc_id: r.n_copies for r in source_mix.copies(docs).collect()}
    assert m.columns == docs.columns and m.count() == sum(n.values())


def test_pipeline_equals_five_brute_force_stages(spark, tmp_path):
    """run() over null, repeated and clashing ids and columns, against plain versions of its stages."""
    import duckdb
    import public_tokenizers as P
    import tiktoken
    from pyspark.sql import functions as F

    import corpus_pipeline as p
    from sensorloom.llm import language_id, secret_scan, source_mix

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).select("doc_id", "text", "lang", "source", "n_chars")
    prose = docs.where("length(text) > 200").limit(6)
    odd = prose.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).union(prose).union(prose.withColumn("text", F.lit(None).cast("string"))).union(
        prose.withColumn("doc_id", F.lit(7).cast(docs.schema["doc_id"].dataType)))
    full = docs.union(odd)
    for name in ("row_key", "row_times", "row_number", "_keep", "_n", "_k", "key", "node", "size", "u", "rate"):
        full = full.withColumn(name, F.lit(name))
    full.write.parquet(str(tmp_path / "documents.parquet"))
    full = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert p.mix_sources(spark, p.drop_near_duplicates(spark, full, ""), "").columns == full.columns

    rows = [(r.doc_id, r.text, r.source) for r in full.collect()]
    model = language_id.train(language_id.labelled_sample(full))
    h, n = model.entropies([t or "" for _, t, _ in rows], model.table())
    rows = [r for r, e, k in zip(rows, h, n) if k and e.min() <= model.bound[e.argmin()]]
    kept, seen = [], {}
    for r in rows:  # rows of equal id and text are one document
        seen.setdefault(r[:2], r)
    rows = sorted(seen.values(), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    comp = brute_components([(k, t) for k, (_, t, _) in enumerate(rows)])
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(comp[k][1], []).append(r)
    # the smallest id stays; of several texts of one smallest id any may
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    got = p.drop_near_duplicates(spark, p.identify_language(spark, full, ""), "")
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in kept)
    assert all(any(x.doc_id == r[0] and x.text == r[1] for r in g) for x in got.collect() for g in [next(g for g in groups.values() if any(r[:2] == (x.doc_id, x.text) for r in g))])

    rows = [(x.doc_id, x.text, x.source) for x in got.collect()]
    cuts = secret_scan.fdr_cuts(Counter((cls, q if q <= secret_scan.FDR else 1.0) for _, t, _ in rows if t for cls, q, _, _ in secret_scan.token_tests(t)))
    rows = [(d, secret_scan.redact(t, secret_scan.scan(t, cuts)), s) for d, t, s in rows]
    table = duckdb.connect()
    table.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    table.executemany("insert into documents values (?, ?, ?)", rows)
    taken = {}
    for d, size, _, _, words in table.execute(source_mix.SQL).fetchall():
        if d is not None:
            taken[d] = taken.get(d, 0) + (words // size if size else 0)
    out = p.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out if r.doc_id is not None and r.doc_id != 7) == Counter({d: n for d, n in taken.items() if n and d != 7})
    ranks = byte_bpe.coder(byte_bpe.default_ranks()).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t, _ in rows:
        ids = enc.encode_ordinary(t)
        want.setdefault(d, set()).add((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert out and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id] for r in out)
