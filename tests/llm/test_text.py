"""HTML extraction, secret scan, BPE, language ID: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import html
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import byte_bpe, html_extract, language_id, secret_scan

SF = "/root/testdata/sf0.001"


def test_pages_equal_their_articles(spark):
    src = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_extract.op2_html_extract(spark, SF).collect()
    assert len(got) == len(src)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", src[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", body)]
        want = "\n".join(p for p in parts if p)
        assert r.text == want and r.n_chars == len(want)


PAGE = """<html><head><title>T</title><script>if (a < b) "<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav>
<div class="cookie-notice">We use cookies</div><aside>side</aside><main><div class="post"><h1>Title {k}</h1><p>First &amp; {k}   para<br>more</p><p>Second {k}<ul><li>a{k}<li>b</ul>
<form><input value="x">Subscribe</form><div class="ad">Buy</div></div></main><section id="comments"><p>Nice!</p></section><footer>&copy; foot</footer></body></html>"""


def test_boilerplate_goes(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{k}", str(k)), "w") for k in range(6)] + [(10, None, None, "w"), (11, "http://h.example/x", "", "w"), (12, "http://o/x", "<p>only <b>this</b>!", "w"), (13, "http://o/x", "plain < text &lt;", "w"), (13, "http://o/x", "<" * 3000, "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    out = html_extract.main_text(df)
    got = {r.page_id: r.text for r in out.collect()}
    assert got[3] == "Title 3\nFirst & 3 para more\nSecond 3\na3\nb"
    assert got[10] == got[11] == "" and got[12] == "only this!" and out.count() == len(rows)
    assert html_extract.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "div", "main"])
def test_container_holds_title_lead_and_body(tag):
    page = lambda k: f"<html><body><nav>menu</nav><{tag}><h1>Title {k}</h1><div class=lead><p>Lead {k} {'word ' * 20}</p></div><div class=body><p>Body {k} {'text ' * 80}</p></div></{tag}><footer>foot</footer></body></html>"
    wrapper = html_extract.induce([page(k) for k in range(5)])
    assert html_extract.extract(page(9), wrapper) == f"Title 9\nLead 9 {'word ' * 20}".strip() + f"\nBody 9 {'text ' * 80}".rstrip()


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def varied(k, n=40):
    return " ".join(WORDS[(k * 7 + j * j) % 10] for j in range(n)) + f" {k}"


def test_article_text_stays_whatever_its_class_or_sameness(spark):
    a = lambda k: f"<body><article><h1>T{k}</h1><p>Body {k}</p><ul><li>same item</li></ul><blockquote>Same quote</blockquote><table><tr><td>cell</td></tr></table></article></body>"
    b = lambda k: f"<body><article><h1>T{k}</h1><p class='related'>One {k}</p><div class='share-holders'><p>Two {k}</p></div><div class='share-buttons'>Tweet</div><section id='comments'><p>Nice {k}</p></section></article></body>"
    rows = [(k, f"http://a/{k}", a(k)) for k in range(9)] + [(100 + k, f"http://b/{k}", b(k)) for k in range(9)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "T0\nBody 0\nsame item\nSame quote\ncell"
    assert got[103] == "T3\nOne 3\nTwo 3"


def test_the_wrapper_decides_where_no_tag_does(spark):
    """Hosts of plain div elements: what is constant is template, link groups are menus, the slots make the container."""
    page = lambda k: f"""<html><body><div class="top"><div>Example site</div><ul><li><a href=/{k}>{WORDS[k % 10]}</a></li><li><a href=/x>{WORDS[k % 7]}</a></li></ul></div>
<div class="wrap sidebar-left"><div class="c1"><div>Standing invitation to write to us</div><h1>Title {k}</h1><p>{varied(k)}</p><p>{varied(k + 1)}</p></div></div><div class="low">All rights reserved</div></body></html>"""  # noqa: E731
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == f"Title 4\n{varied(4)}\n{varied(5)}"
    assert html_extract.extract(page(4), None) != got[4] and "Standing invitation" in html_extract.extract(page(4), None)


def test_layout_classes_and_nested_articles():
    page = "<body><div class='content sidebar-right'><article><h1>A</h1><p>one</p><article><p>two</p></article></article></div><div class='sidebar'><p>side</p></div></body>"
    assert html_extract.extract(page, None) == "A\none\ntwo"


def test_large_pages_and_templates_of_whole_hosts(spark):
    def page(k):
        parts = "".join(f"<h2>Part {k} {j}</h2><p>Text {k} {j} {'word ' * 10}</p><figure>fig {k} {j}</figure>" for j in range(300))
        return f"<html><body><div class=text>{parts}</div><div class=date>Day {k}</div></body></html>"

    wrapper = html_extract.induce([page(k) for k in range(5)])
    got = html_extract.extract(page(7), wrapper).split("\n")
    assert len(got) == 901 and "Text 7 299 " + "word " * 9 + "word" in got
    # the fitted pages are near copies; the host's other pages do not have their quotation
    near = lambda k: f"<body><div><p>copy {k}</p><blockquote>A quotation</blockquote><pre>Shown everywhere</pre></div></body>"
    other = lambda k: f"<body><div><p>text {k}</p><blockquote>Words {k}</blockquote><pre>Shown everywhere</pre></div></body>"
    known = spark.createDataFrame([("h", json.dumps(html_extract.induce([near(k) for k in range(5)])))], "host string, wrapper string")
    rows = spark.createDataFrame([("h", near(k) if k < 5 else other(k)) for k in range(20)], "host string, html string").repartition(3)
    wrapper = json.loads(html_extract.confirmed(rows, known).first().wrapper)
    assert html_extract.extract(near(1), wrapper) == "copy 1\nA quotation"
    assert html_extract.match(*[html_extract.parse("<div>" * 3000)] * 2)


def test_simple_tree_matching():
    a, b = html_extract.parse("<div><p>a</p><ul><li>1</li></ul></div>"), html_extract.parse("<div><h1>x</h1><p>b</p><ul><li>1</li><li>2</li></ul></div>")
    pairs = html_extract.match(a, b)
    assert sorted(x.sig for x, _ in pairs) == ["", "div", "li", "p", "ul"]


def brute_base(t):
    spans = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 8]
    spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    order = {"assign": 0, "access": 1, "hex": 2}
    return [f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]]))]


ODD = ["é password: 'abcdefgh12' x", "Token=short api-key=12345678 APIKEY = \"zzzzzzzz\"", "AKIA1234567890AB AKIA12", "f" * 31 + " " + "0" * 32 + "g", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "", None]


def test_secrets_equal_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10_000 + k, t) for k, t in enumerate(ODD)]
    for r in secret_scan.secrets(docs(rows)).collect():
        want = brute_base(dict(rows)[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))


def test_battery_tells_random_from_prose():
    rng = np.random.default_rng(1)
    alphabet = list(secret_scan.ALPHABETS["base64"])
    keys = ["".join(rng.choice(alphabet, 40)) for _ in range(200)]
    hits = sum(bool(secret_scan.random_spans(f"the key {k} here")) for k in keys)
    assert hits >= 180
    prose = ["Donaudampfschifffahrtsgesellschaftskapitaen", "internationalization-of-everything", "averylongwordwithoutanymeaning", "=" * 40, "-" * 60, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    assert not any(secret_scan.random_spans(f"a {p} b") for p in prose)


@pytest.mark.parametrize("token", ["12345678901234567890", "abc123" * 4, "aB1" * 8, "0123456789abcdef0123", "file_v1_v2_v3_v4_v5_v6", "abcdefghijklmnopqrstuvwxyz", "getUserAccountBalanceById", "qwertyuiopasdfghjklzxcvbnm", "ACGTACGGTCATTGACCAGTACGATCAG", "MAX_RETRY_COUNT_EXCEEDED_2", "correcthorsebatterystaple", "2024-03-15-some-article-title"])
def test_regular_and_natural_tokens_are_no_secrets(token):
    assert not secret_scan.random_spans(f"see {token} here") and not secret_scan.random_spans(token * 3)


@pytest.mark.parametrize("name, n, least", [("hex", 31, 0.9), ("base32", 32, 0.9), ("lower", 40, 0.9), ("base36", 32, 0.9), ("BASE36", 40, 0.9), ("base62", 24, 0.9), ("base64", 24, 0.9), ("base64url", 43, 0.95)])
def test_power_by_encoding(name, n, least):
    rng = np.random.default_rng(n)
    keys = ["".join(rng.choice(list(secret_scan.ALPHABETS[name]), n)) for _ in range(300)]
    assert sum(bool(secret_scan.random_spans(f"a {k} b")) for k in keys) >= least * 300


def test_false_discoveries_by_length_class():
    """Glued prose against one random key in ten: under FDR false ones a class, most keys found; a key inside a path is found by its part."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t and len(t) > 400]
    words = [w for t in texts for w in re.findall("[A-Za-z]{2,}", t) if any(c in "aeiou" for c in w)]
    for n in (24, 40):
        tests, truth = [], []
        for k in range(3000):
            random = k % 10 == 0
            a = int(rng.integers(0, len(words) - 30))
            token = "".join(rng.choice(list(secret_scan.ALPHABETS["base62"]), n)) if random else "".join(words[a : a + 30])[:n]
            (cls, p, _, _), *_ = secret_scan.token_tests(token)
            tests.append((cls, p))
            truth.append(random)
        cuts = secret_scan.fdr_cuts(Counter(tests))
        hit = [p <= cuts.get(cls, -1) for cls, p in tests]
        true = sum(h and t for h, t in zip(hit, truth))
        assert true >= 0.7 * sum(truth) and sum(hit) - true <= max(3, 2 * secret_scan.FDR * sum(hit))
    key = "".join(rng.choice(list(secret_scan.ALPHABETS["base62"]), 40))
    assert secret_scan.random_spans(f"some/path/of/words/{key}/and/more/words/of/the/path" + "/to/it" * 100)


def test_windows_of_long_tokens_are_tested():
    rng = np.random.default_rng(2)
    blob = lambda n: "".join(rng.choice(list(secret_scan.ALPHABETS["base64"]), n))
    path = "some/path/of/words/" * 60
    for head, key, tail in (("A" * 300, blob(2000), ""), (path, blob(1200), path), ("", blob(1500), path)):
        spans = secret_scan.random_spans(f"key {head}{key}{tail} end")
        at = 4 + len(head)
        assert len(spans) == 1 and spans[0][0] <= at + 512 and spans[0][1] >= at + len(key) - 512
    assert not secret_scan.random_spans(path) and not secret_scan.random_spans("x" * 5000)


def test_false_discoveries_are_controlled_over_all_documents(docs):
    slugs = ["2024-03-15-some-article-title", "backup_2024_01_31_final_version"]
    key = "q7Gz1Kx0Rb4Tn9Wc3Yv8Lm2Pd6Hf5Js1Au0Ei7Oq"
    rows = [(k, f"internationalization and internationalization-of-everything {k}") for k in range(300)] + [(1000 + k, f"see {s} here") for k, s in enumerate(slugs)]
    df = docs(rows + [(2000, f"key {key} end"), (2001, None), (2002, "")])
    got = {r.doc_id: r.spans for r in secret_scan.secrets(df).collect()}
    assert len(got) == 305 and {d: x for d, x in got.items() if x} == {2000: f"random:4:{4 + len(key)}"}
    red = {r.doc_id: r.text for r in secret_scan.redacted(df).collect()}
    assert red == {**dict(rows), 2000: "key <secret> end", 2001: None, 2002: ""}
    tests = [x for _, t in rows + [(0, key)] for x in secret_scan.token_tests(t)]
    for cls, cut in secret_scan.corpus_cuts(df).items():  # Benjamini-Hochberg, rank by rank
        p = sorted(x[1] for x in tests if x[0] == cls)
        assert cut == max(q for k, q in enumerate(p, 1) if q <= secret_scan.FDR * k / len(p))


def test_secret_edges(edge):
    assert secret_scan.secrets(edge).count() == edge.count() and secret_scan.secrets(edge.limit(0)).count() == 0
    red = secret_scan.redacted(edge)
    assert red.columns == edge.columns and red.count() == edge.count()
    assert secret_scan.redact("a token=abcdefgh b", secret_scan.scan("a token=abcdefgh b")) == "a <secret> b"


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.coder(byte_bpe.default_ranks())


def test_bpe_equals_the_library(spark, coder):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(5)
    letters = list("ab's'tre'll ve \n\t  ''.,!12 ½é漢 \u00a0🙂$_\0")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)] + ["a" * 3000, "'s", "'", " 's", "ab" * 200]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t, ids in zip(texts, coder.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert coder.decode(ids) == t.encode() and coder.offsets(ids)[-1] == len(t.encode())


def test_bpe_query_and_edges(edge):
    path = byte_bpe.default_ranks()
    rows = byte_bpe.encode(edge, path, keep_ids=True).collect()
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    assert len(rows) == edge.count()
    for r in rows:
        assert r.n_tokens == len(r.ids) // 4 and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.encode(edge.limit(0), path).count() == 0


def test_language_held_out(spark):
    got = {r.doc_id: r for r in language_id.op8_language_id(spark, "/root/testdata/sf0.01").collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(true)
    held = [d for d in got if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert np.mean([got[d].lang_pred == true[d] for d in held]) > 0.97
    assert np.mean([got[d].rejected for d in got]) < 0.01


def test_language_edges(edge, docs):
    model = language_id.train([])
    assert all(r.lang_pred == "und" and r.score == 0 for r in language_id.predict(edge, model).collect())
    model = language_id.train([("en", "the cat and the dog " * 5), ("de", "der Hund und die Katze " * 5)] * 6)
    got = {r.doc_id: r for r in language_id.predict(edge, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].rejected
    assert language_id.predict(edge.limit(0), model).count() == 0
    assert language_id.keep_accepted(edge, model).columns == edge.columns
    # a text is scored alike whatever stands beside it
    one = language_id.predict(docs([(1, "der Hund")]), model).first().cross_entropy
    two = [r.cross_entropy for r in language_id.predict(docs([(0, "zzzz"), (1, "der Hund")]), model).collect() if r.doc_id == 1][0]
    assert abs(one - two) < 1e-12


def test_kneser_ney_sums_to_one():
    m = language_id.train([("en", "abracadabra abacus cab " * 3)] * 4).models[0]
    ctx = m.contexts[language_id.ORDER][0][:5]
    for c in ctx:
        keys = (int(c) << language_id.BITS) + np.arange(m.size)
        assert abs(m.prob(keys).sum() - 1) < 1e-9


def test_kneser_ney_equals_brute_force():
    """Cross-entropies from plain dictionaries of n-grams."""
    fit = {"aa": ["the cat sat on the mat", "a cat, a hat & the rat!", "that is it"], "bb": ["die katze sitzt", "eine matte ist da", "das ist es"]}
    held = ["the rat is on", "die ist das", "xyz ça", "a", "Äß", "the the the"]
    model = language_id.train([(lang, t) for lang, texts in fit.items() for t in texts])
    letters_of = lambda t: "".join(c.lower() if c.isalpha() else " " for c in t)
    known = {c for texts in fit.values() for t in texts for c in letters_of(t)} - {" "}
    size = len(known) + 2

    def symbols(t):
        out = []
        for c in letters_of(t):
            if c != " " or not out or out[-1] != " ":
                out.append(c if c == " " or c in known else "?")
        return out

    def grams(t):
        padded = [" "] * 3 + symbols(t)
        return [tuple(padded[k : k + 4]) for k in range(len(padded) - 3)]

    for k, lang in enumerate(model.langs):
        counts = {4: Counter(g for t in fit[lang] for g in grams(t))}
        for m in (3, 2, 1):
            counts[m] = Counter(g[1:] for g in counts[m + 1])  # continuation counts

        def prob(g):
            if not g:
                return 1 / size
            m, lower = len(g), prob(g[1:])
            after = {h: n for h, n in counts[m].items() if h[:-1] == g[:-1]}
            if not after:
                return lower
            total = sum(after.values())
            return max(after.get(g, 0) - language_id.DISCOUNT, 0) / total + language_id.DISCOUNT * len(after) / total * lower

        got, _ = model.entropies(held, model.table())
        for j, t in enumerate(held):
            g = grams(t)
            assert abs(got[j, k] + sum(np.log(prob(x)) for x in g) / len(g)) < 1e-4


def test_very_long_texts_and_pages_pass_every_operator(spark, docs):
    """Two texts of a megabyte each beside short ones, a page of two megabytes, an address of 100,000 characters, repeated rows."""
    from sensorloom.llm import ngram_jaccard, quality_rules, source_mix, suffix_dedup, url_filter

    rng = np.random.default_rng(1)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(5000)])
    long = " ".join(rng.choice(words, 170_000))
    df = docs([(1, long), (2, long[:500_000] + "x" + long[500_000:]), (3, "short text"), (3, "short text"), (4, None)])
    got = {r.doc_id: r for r in ngram_jaccard.classes(df).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[1].n_shingles > 160_000
    cut = {r.doc_id: r for r in suffix_dedup.removals(df).collect()}
    assert cut[1].n_removed == 0 and cut[2].n_bytes - cut[2].n_removed <= 1 and cut[3].n_removed == 0
    assert sorted(r.size for r in source_mix.copies(df).collect()) == [0, 2, 2, 170_000, 170_000]
    assert quality_rules.ledger(df).count() == secret_scan.secrets(df).count() == 5
    assert language_id.predict(df, language_id.train([("en", long[:20_000]), ("de", "eins zwei drei")])).count() == 5
    page = "<html><body><article>" + "".join(f"<p>{w}</p>" for w in rng.choice(words, 180_000)) + "</article></body></html>"
    url = "http://a.example/" + "p/" * 50_000
    pages = spark.createDataFrame([(1, url, page), (1, url, page), (2, url + "?q", "<p>a"), (3, None, None)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_extract.main_text(pages).collect()) == [0, 1, 6 * 180_000 - 1, 6 * 180_000 - 1]
    judged = url_filter.judge(pages).collect()
    assert len(judged) == 4 and {r.path for r in judged if r.page_id in (1, 2)} == {"/" + "p/" * 50_000}
