"""HTML main-text extraction by wrapper induction.

``induce`` aligns the DOM trees of a few pages of one host by simple tree
matching. Aligned leaves with equal text on all pages are template; leaves that
vary or do not align are slots. The wrapper of a host is the path of the
deepest container that holds all slot text outside navigation, notices, forms
and the like (or of the article or main element around that), and the constant
texts inside it. ``extract`` then reads every whole page with its host's wrapper.

Some elements are boilerplate by their tag, wherever they stand (``DROP``, and a
header of the body). Outside content, so are elements with a marked class, id or
role, and groups of links with hardly any other text. Inside content (the
wrapper's container, an article or main element) only elements that group others
are, and only where every part of a class word is a mark or a filler
(``share-buttons``, not ``share-holders``); text elements (``PROSE``) stay. There
too, a constant text is template only if it is no text element's.

At most ``PAGES`` pages a host, the smallest by hash, are aligned (a documented
bound of the fit). A constant text found there is template only if ``TEMPLATE``
of all the host's pages show it; every page is extracted. Wrappers are one small row a host.

Defined results: null and empty html give an empty text. A null address has the
empty host. A page without the wrapper's container falls back to its article,
main or body element. Repeated rows are extracted alike; an empty table gives
an empty result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import json
import os.path
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import as_text, bounded, longs, materialize, read, trimmed

PAGES, TEMPLATE = 5, 0.9

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROP = set("script style noscript template head title nav footer aside form button select option textarea iframe object svg canvas audio video dialog menu label input".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag on the left closes an open element on the right, up to the named scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table tbody thead tfoot select article section div body".split())
#: Text elements: inside content they are kept whatever their class, and if they are constant.
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption summary span em strong b i u a code q cite small sub sup mark time abbr".split())
#: Words of class, id and role values that mark boilerplate.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright footer masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside a mark.
FILLERS = set("area bar block bottom box btn btns button buttons col column container content entries form group icon icons inline inner item items left link links list main outer panel post posts articles right section signup site slot stories text thread title top unit wrap wrapper".split())
WORD = re.compile(r"[^\s_-]+")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


HARD, SOFT, OUTSIDE = 1, 2, 4  # boilerplate anywhere, also inside content, only outside content


class Node:
    __slots__ = ("tag", "sig", "kids", "path", "drop")

    def __init__(self, tag: str, sig: str, path: str, drop: int):
        self.tag, self.sig, self.path, self.drop, self.kids = tag, sig, path, drop, []


def _marks(value: str, tag: str) -> int:
    drop = 0
    for token in value.lower().split():
        words = set(WORD.findall(token))
        if words & MARKS:
            drop |= OUTSIDE if tag in PROSE or not words <= MARKS | FILLERS else OUTSIDE | SOFT
    return drop


def _open(parent: Node, tag: str, attrs: str) -> Node:
    mark, drop = "", HARD if tag in DROP or (tag == "header" and parent.tag in ("", "html", "body")) else 0
    if attrs and "=" in attrs:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
        if "class" in found:
            mark = "." + ".".join(sorted(found["class"].lower().split()))
        if tag not in ("body", "html", "article", "main"):
            for v in found.values():
                drop |= _marks(v, tag)
    node = Node(tag, tag + mark, f"{parent.path}/{tag}{mark}", drop)
    parent.kids.append(node)
    return node


def _weigh(root: Node) -> None:
    """Groups of two links or more with hardly any other text are boilerplate outside content; what holds a main element, a titled article, or a title and half of the text is none."""
    order, work = [], [(root, False)]
    while work:
        node, linked = work.pop()
        linked |= node.tag == "a"
        order.append((node, linked))
        work += [(k, linked) for k in node.kids if isinstance(k, Node)]
    size: dict[int, tuple] = {}
    for node, linked in reversed(order):
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        below = [size[id(k)] for k in node.kids if isinstance(k, Node)]
        text, link, links = own + sum(x[0] for x in below), (own if linked else 0) + sum(x[1] for x in below), (node.tag == "a") + sum(x[2] for x in below)
        title = node.tag == "h1" or any(x[3] for x in below)
        content = node.tag == "main" or (node.tag == "article" and title) or any(x[4] for x in below)
        size[id(node)] = text, link, links, title, content
        if links > 1 and link >= 0.9 * text and node.tag in ("div", "ul", "ol", "section", "table", "dl"):
            node.drop |= OUTSIDE
    half = size[id(root)][0] / 2
    for node, _ in order:
        text, _, _, title, content = size[id(node)]
        if content or (title and text >= half):
            node.drop &= HARD


def parse(page: str) -> Node:
    """A forgiving tree of elements and text strings; character references stay encoded."""
    root = Node("", "", "", 0)
    stack, at = [root], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            continue  # raw text is never main text
        if not (tag := (m[4] or "").lower()):
            continue
        if m[3]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "body", "html") and tag not in ("article", "body", "html", "main", "section", "div"):
                    break
            continue
        if tag in BLOCK:  # a block ends an open paragraph and the inline elements in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and not (tag == "tr" and stack[k].tag == "tr"):
                    break
        node = _open(stack[-1], tag, m[5] or "")
        if tag not in VOID and not (m[5] or "").endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].kids.append(page[at:])
    _weigh(root)
    return root


def _clean(raw: str) -> str:
    return " ".join(entities.unescape(raw).split()) if "&" in raw else " ".join(raw.split())


def blocks(node: Node) -> list[tuple[str, str]]:
    """(path|text, text) of the blocks below ``node`` in page order, without boilerplate."""
    gone = HARD | SOFT | (OUTSIDE if node.tag in ("", "html", "body") else 0)
    out: list[tuple[str, str]] = []
    part: list[str] = []

    def flush(path):
        if part:
            text = _clean("".join(part))
            part.clear()
            if text:
                out.append((f"{path}|{text}", text))

    work: list = [(node, 0)]
    while work:
        item, k = work.pop()
        if k == 0 and item.tag in BLOCK:
            flush("")
        kids = item.kids
        while k < len(kids):
            kid = kids[k]
            k += 1
            if isinstance(kid, str):
                part.append(kid)
            elif kid.tag == "br":
                part.append(" ")
            elif kid.tag in ("article", "main") or not kid.drop & gone:
                work.append((item, k))
                work.append((kid, 0))
                break
        else:
            if item.tag in BLOCK:
                flush(item.path)
    flush("")
    return out


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest order-keeping alignment of two trees' nodes."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def kids(x: Node, y: Node) -> list[Node]:
        there = {k.sig for k in y.kids if isinstance(k, Node)}
        return [k for k in x.kids if isinstance(k, Node) and k.sig in there]

    work = [(a, b)] if a.sig == b.sig else []
    while work:
        x, y = work[-1]
        if (id(x), id(y)) in memo:
            work.pop()
            continue
        xs, ys = kids(x, y), kids(y, x)
        like: dict[str, list[Node]] = {}
        for q in ys:
            like.setdefault(q.sig, []).append(q)
        if todo := [(p, q) for p in xs for q in like[p.sig] if (id(p), id(q)) not in memo]:
            work += todo
            continue
        pairs = []
        if len(xs) == len(ys) == len(like):  # each occurs once: equal ends belong together
            head = next((k for k in range(len(xs)) if xs[k].sig != ys[k].sig), len(xs))
            pairs, xs, ys = list(zip(xs[:head], ys[:head])), xs[head:], ys[head:]
            while xs and xs[-1].sig == ys[-1].sig:
                pairs.append((xs.pop(), ys.pop()))
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, p in enumerate(xs):
            for j, q in enumerate(ys):
                w = memo[id(p), id(q)][0] if p.sig == q.sig else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
        i, j = len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        memo[id(x), id(y)] = 1 + sum(memo[id(p), id(q)][0] for p, q in pairs), pairs

    found, work = [], [(a, b)] if a.sig == b.sig else []
    while work:
        x, y = work.pop()
        found.append((x, y))
        work += memo[id(x), id(y)][1]
    return found


def _skeleton(node: Node) -> Node:
    """A copy with like siblings merged (one record stands for a list) that keeps all text, so that matching stays small."""
    top = Node(node.tag, node.sig, node.path, node.drop)
    work, seen = [(node, top)], {}
    while work:
        src, dst = work.pop()
        known = seen.setdefault(id(dst), {})
        for kid in src.kids:
            if isinstance(kid, str):
                dst.kids.append(kid)
                continue
            if kid.sig not in known:
                known[kid.sig] = Node(kid.tag, kid.sig, kid.path, kid.drop)
                dst.kids.append(known[kid.sig])
            work.append((kid, known[kid.sig]))
    return top


def _own(node: Node) -> str:
    return _clean(" ".join(k for k in node.kids if isinstance(k, str)))


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one host: container path and constant texts within it."""
    trees = [_skeleton(parse(p)) for p in dict.fromkeys(pages)]
    if not trees:
        return {"container": "", "constant": []}
    nodes, work = [], [trees[0]]
    while work:
        x = work.pop()
        if isinstance(x, Node) and not x.drop:
            nodes.append(x)
            work += x.kids
    same = {id(n): True for n in nodes}
    matches = [match(trees[0], other) for other in trees[1:]]
    for found in matches:
        aligned = {id(a): b for a, b in found}
        for n in nodes:
            same[id(n)] &= id(n) in aligned and _own(aligned[id(n)]) == _own(n)
    alone = len(trees) == 1
    slots = [n.path for n in nodes if (alone or not same[id(n)]) and _own(n)]
    for other, found in zip(trees[1:], matches):  # and what only other pages have
        constant = {id(b) for a, b in found if same.get(id(a))}
        work = [other]
        while work:
            x = work.pop()
            if isinstance(x, Node) and not x.drop:
                if id(x) not in constant and _own(x):
                    slots.append(x.path)
                work += x.kids
    # the deepest container of all slot text, and the article or main element around it
    steps = os.path.commonprefix([p.split("/") for p in slots])
    tags = [step.split(".")[0] for step in steps]
    ends = [k for k, tag in enumerate(tags) if tag in ("article", "main", "div", "section", "body", "html", "td")]
    around = [k for k in ends if tags[k] in ("article", "main")]
    container = "/".join(steps[: (around or ends)[-1] + 1]) if ends else ""
    # a constant text is template only where other slots of the container vary
    kept = PROSE if around else {"p", "h1", "h2", "h3"}
    constant = [] if alone else sorted({f"{n.path}|{_own(n)}" for n in nodes if same[id(n)] and n.path.startswith(container + "/") and n.tag not in kept and _own(n)})
    return {"container": container, "constant": constant}


def page_blocks(page: str | None, wrapper: dict | None) -> list[tuple[str, str]]:
    """The blocks of a page's container, template texts among them."""
    if not page:
        return []
    root = parse(page)
    path = (wrapper or {}).get("container") or "/"
    found: dict[str, list[Node]] = {"path": [], "article": [], "main": [], "body": []}
    work: list[tuple[Node, str]] = [(root, "")]
    while work:
        x, inside = work.pop()  # one element of a kind within another counts once
        if x.path == path:
            found["path"].append(x)
            continue
        if x.tag in found and x.tag not in inside:
            found[x.tag].append(x)
            inside += f" {x.tag}"
        work += [(k, inside) for k in reversed(x.kids) if isinstance(k, Node) and not k.drop]
    if found["article"] and not path.endswith("article"):  # a wrapper that is wider or elsewhere yields to the page's own article
        if not any("/article" in n.path for n in found["path"]):
            found["path"] = found["article"]
    tops = found["path"] or found["article"] or found["main"] or found["body"] or [root]
    return [b for top in tops for b in blocks(top)]


def extract(page: str | None, wrapper: dict | None) -> str:
    constant = set((wrapper or {}).get("constant", ()))
    return "\n".join(text for key, text in page_blocks(page, wrapper) if key not in constant)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON). Ranking is cut to PAGES rows a host before the shuffle."""
    first = Window.partitionBy("host").orderBy(F.xxhash64("page_id"), "page_id")
    some = pages.where("html is not null").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PAGES)

    def fit(pdf):
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [json.dumps(induce(pdf.sort_values("rank")["html"].tolist()))]})

    return some.groupBy("host").applyInPandas(fit, "host string, wrapper string")


def _reader():
    """JSON wrappers, parsed once each."""
    parsed: dict[str, dict] = {}

    def get(w):
        if w is not None and w not in parsed:
            if len(parsed) > 10_000:
                parsed.clear()
            parsed[w] = json.loads(w)
        return parsed.get(w)

    return get


def confirmed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """host, wrapper with those constant texts only that ``TEMPLATE`` of all the host's pages show."""
    some = known.where("wrapper not like '%\"constant\": []%'")

    def count(batches):
        get = _reader()
        for pdf in batches:  # partial counts of a batch; k is -1 for the pages themselves
            n: Counter = Counter()
            for host, page, w in zip(pdf["host"], pdf["html"], pdf["wrapper"]):
                wrapper = get(w)
                shown = {key for key, _ in page_blocks(page, wrapper)}
                n[host, -1] += 1
                n.update((host, k) for k, c in enumerate(wrapper["constant"]) if c in shown)
            yield pd.DataFrame([(*key, v) for key, v in n.items()], columns=["host", "k", "n"])

    seen = rows.where("html <> ''").join(some, "host").select("host", "html", "wrapper").mapInPandas(trimmed(count), "host string, k int, n long")
    seen = seen.groupBy("host", "k").agg(F.sum("n").alias("n"))
    pages = F.max(F.when(F.col("k") < 0, F.col("n")))
    kept = seen.groupBy("host").agg(pages.alias("pages"), F.collect_list(F.struct("k", "n")).alias("seen"))
    kept = kept.select("host", F.expr(f"transform(filter(seen, x -> x.k >= 0 and x.n >= {TEMPLATE} * pages), x -> x.k)").alias("kept"))

    def narrow(batches):
        for pdf in batches:
            out = []
            for w, k in zip(pdf["wrapper"], pdf["kept"]):
                w = json.loads(w)
                out.append(json.dumps(w | {"constant": [w["constant"][i] for i in (sorted(k) if k is not None else ())]}))
            yield pd.DataFrame({"host": pdf["host"], "wrapper": out})

    return known.join(kept, "host", "left").select("host", "wrapper", "kept").mapInPandas(narrow, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = bounded(pages).select("page_id", "url", "html", F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")).alias("host"))
    known = materialize(confirmed(rows, materialize(wrappers(rows))))

    def run(batches):
        get = _reader()
        for pdf in batches:
            text = [extract(page, get(w)) for page, w in zip(pdf["html"], pdf["wrapper"])]
            yield pd.DataFrame({"page_id": longs(pdf["page_id"]), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return rows.join(known, "host", "left").select(as_text("page_id"), "url", "html", "wrapper").mapInPandas(trimmed(run), "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
