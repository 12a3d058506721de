"""Secret scans: three base kinds, and a randomness test battery over other tokens.

Base kinds are found by their patterns. The battery looks at every further
token of ``MIN_TOKEN`` or more characters of an encoding's alphabet, and takes
three kinds of statistics for the encoding inferred: the chi-squared of the
alphabet (in the form of equal pairs of characters, of which it is a linear
function, and over two cells, rare letters and others), the runs of vowels and
consonants, and the serial statistic of how often a
character is followed by one of another class (digit, lower case, upper case).
Each is used twice:

* against "natural", the null hypothesis under control: letters of European
  prose, vowels and consonants that alternate, classes that stay. Natural text
  has more equal pairs, fewer rare letters, more runs and fewer class changes
  than a random key, so one-sided p-values say how unlikely a natural token is
  to look this random. Fisher's method combines them.
* against "drawn uniformly": a token must also pass for random. Chi-squared on
  both sides (a counting token is too even), the runs above and below the
  alphabet's middle, and the serial correlation at every lag up to half of the
  token (a periodic token repeats) reject it below ``GATE``.

Benjamini-Hochberg control over all documents' tokens of a length class (the
length-aware part: short tokens carry weak evidence and are controlled among
themselves) keeps the share of natural tokens among those flagged under
``FDR``. Besides whole tokens, their parts between joints and, in tokens over
the widths of ``WINDOWS``, overlapping windows are tested; what passes is
reported, merged. One pass over the documents counts the p-values by class (in
steps of an eighth of a power of two, rounded up, so the table is bounded); only
those counts are shuffled, and a second pass applies the cuts. Digits alone are
never taken for a secret.

Defined results: null and empty texts have no spans. Offsets count code points,
ends are exclusive. Overlapping battery spans are not added to base spans that
contain them. Repeated rows are scanned alike; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import as_text, bounded, longs, read, trimmed

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs: the same matches as [0-9a-f]+ of 32 or more
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 8, 16

MIN_TOKEN, FDR, GATE = 20, 1e-2, 1e-6
WINDOWS = ((64, 16), (512, 128))  # width and step
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
PART = re.compile(rf"[A-Za-z0-9]{{{MIN_TOKEN},}}")
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Alphabets by encoding, the narrowest first.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _LOWER + _DIGITS,
    "BASE36": _UPPER + _DIGITS,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
CODES = {name: {c: k for k, c in enumerate(a)} for name, a in ALPHABETS.items()}
# Letters of European prose in percent, a to z.
PERCENT = (7.5, 1.3, 2.8, 4.2, 13.5, 1.5, 1.9, 3.5, 7.0, 0.3, 0.7, 4.3, 2.6, 7.7, 6.8, 2.1, 0.5, 6.6, 6.8, 7.6, 3.4, 1.2, 1.2, 0.4, 1.3, 0.5)
#: Natural tokens: the share of digits, of capitals among letters of both cases, of rare letters, of vowel changes between letters, of class changes.
DIGIT, CAPITAL, SCARCE, VOWEL, CLASS = 0.1, 0.1, 0.07, 0.6, 0.12
VOWELS, RARE = frozenset("aeiouyAEIOUY"), frozenset("jkqvwxzJKQVWXZ")


def _natural(alphabet: str) -> list[float]:
    both = "a" in alphabet and "A" in alphabet
    letter = dict(zip(_LOWER, PERCENT))
    share = lambda c: (letter[c.lower()] / 100 * ((CAPITAL if c.isupper() else 1 - CAPITAL) if both else 1)) if c.isalpha() else (DIGIT / 10 if c.isdigit() else 0.01)
    all_of = sum(map(share, alphabet))
    return [share(c) / all_of for c in alphabet]


#: Sums of squares and of cubes of the natural shares, by encoding.
MOMENTS = {name: (sum(q * q for q in x), sum(q**3 for q in x)) for name, x in ((name, _natural(a)) for name, a in ALPHABETS.items())}


def _upper_p(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_z(x: float, df: int) -> float:
    """The normal score of a chi-squared value, by the Wilson-Hilferty cube root."""
    return ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def _binomial_p(k: int, n: int, p: float) -> float:
    """Chance of k or more of n."""
    if k <= 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for j in range(k, n + 1):
        total += term
        term *= (n - j) / (j + 1) * p / (1 - p)
        if term < total * 1e-12:
            break
    return min(1.0, total)


def _fisher(ps: list[float]) -> float:
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term, total = 1.0, 0.0
    for j in range(len(ps)):
        total += term
        term *= half / (j + 1)
    return min(1.0, math.exp(-half) * total)


def encoding_of(token: str) -> str | None:
    """The narrowest encoding whose alphabet holds the token; none if padding is most of it."""
    body = token.rstrip("=")
    if len(body) < MIN_TOKEN - 4:
        return None
    body = set(body)
    return next((name for name, codes in CODES.items() if body <= codes.keys()), None)


def _pairs(body: str) -> int:
    """Equal pairs of characters; chi-squared against k equal shares is k (n + 2 pairs) / n - n."""
    return sum(c * (c - 1) // 2 for c in Counter(body).values())


def natural_p(token: str, encoding: str) -> float:
    """Chance that a natural token looks as random as this one does: Fisher's combination of the statistics."""
    body = token.rstrip("=")
    n, (square, cube) = len(body), MOMENTS[encoding]
    mean = n * (n - 1) / 2 * square
    var = n * (n - 1) / 2 * (square - square**2) + n * (n - 1) * (n - 2) * (cube - square**2)
    ps = [_upper_p((mean - _pairs(body) - 0.5) / math.sqrt(var))]
    if encoding not in ("hex", "HEX"):
        ps.append(_binomial_p(sum(c in RARE for c in body), sum(map(str.isalpha, body)), SCARCE))
    letters = [(a in VOWELS) != (b in VOWELS) for a, b in zip(body, body[1:]) if a.isalpha() and b.isalpha()]
    if letters:
        same = len(letters) - sum(letters)
        ps.append(_binomial_p(same, len(letters), 1 - VOWEL))
    if encoding not in ("lower", "upper"):
        # a capitalised word is no change
        kinds = [a.isdigit() != b.isdigit() or (a.islower() and b.isupper()) for a, b in zip(body, body[1:]) if a.isalnum() and b.isalnum()]
        ps.append(_binomial_p(sum(kinds), len(kinds), CLASS))
    return _fisher(ps)


def battery(token: str, encoding: str) -> tuple[float, float, float]:
    """p-values of alphabet uniformity, runs and serial correlation (the least of all lags, times their number) under uniform draws."""
    codes, body = CODES[encoding], token.rstrip("=")
    x, k, n = [codes[c] for c in body], len(codes), len(body)
    uniform = _two_sided(_chi2_z(max(0.0, k * (n + 2 * _pairs(body)) / n - n), k - 1))
    side = [v >= k / 2 for v in x]
    up = sum(side)
    down = n - up
    if not up or not down:
        return uniform, 0.0, 0.0
    mean = 2 * up * down / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = _two_sided((1 + sum(a != b for a, b in zip(side, side[1:])) - mean) / math.sqrt(var)) if var > 0 else 1.0
    mid = sum(x) / n
    x = [v - mid for v in x]
    square, lags = sum(v * v for v in x), max(1, n // 2)
    if not square:
        return uniform, runs, 0.0
    z = max(abs(sum(a * b for a, b in zip(x, x[lag:])) / square + (n - lag) / (n * n)) * n / math.sqrt(n - lag) for lag in range(1, lags + 1))
    return uniform, runs, min(1.0, lags * _two_sided(z))


def _probes(start: int, end: int, text: str) -> Iterator[tuple[int, int]]:
    n, widest = end - start, WINDOWS[-1][0]
    if n <= widest:
        yield start, end
    for width, step in WINDOWS:
        if n > width:
            for a in [*range(start, end - width, step), end - width]:
                yield a, a + width
    for m in PART.finditer(text, start, end):
        if m.end() - m.start() < min(n, widest + 1):
            yield m.span()


def token_tests(text: str) -> Iterator[tuple[int, float, int, int]]:
    """(length class, p, start, end) of every token up to the widest window, of the parts and windows of longer or jointed ones."""
    for m in TOKEN.finditer(text):
        for a, b in _probes(*m.span(), text):
            probe, p = text[a:b], 1.0
            encoding = encoding_of(probe)
            if encoding not in (None, "decimal"):
                p = natural_p(probe, encoding)
                p = 2 ** (math.ceil(8 * math.log2(p)) / 8) if p > 1e-300 else 1e-300
                if p <= FDR and 3 * min(battery(probe, encoding)) < GATE:
                    p = 1.0
            yield (b - a).bit_length(), p, a, b


def random_spans(text: str, cuts: dict[int, float] | None = None) -> list[tuple[int, int]]:
    """Tokens that the battery takes for secrets: p up to their class's cut (by default, of this text alone); windows that meet are one span."""
    tests = list(token_tests(text))
    if cuts is None:
        cuts = fdr_cuts(Counter((cls, p) for cls, p, _, _ in tests))
    return _merged([(a, b) for cls, p, a, b in tests if p <= cuts.get(cls, -1.0)])


def fdr_cuts(counts: dict[tuple[int, float], int]) -> dict[int, float]:
    """Benjamini-Hochberg: by length class, the largest p that passes. ``counts`` has the tests by (class, p)."""
    total, rank, cuts = Counter(), Counter(), {}
    for (cls, _), n in counts.items():
        total[cls] += n
    for (cls, p), n in sorted(counts.items()):
        rank[cls] += n
        if p <= FDR * rank[cls] / total[cls]:
            cuts[cls] = p
    return cuts


def corpus_cuts(documents: DataFrame) -> dict[int, float]:
    """The cuts over the tokens of all documents. p goes in steps, so the table of counts by (class, p) stays small."""

    def count(batches):
        for pdf in batches:
            # a p over FDR never passes, so it is counted as 1
            n = Counter((cls, p if p <= FDR else 1.0) for text in pdf["text"] if text for cls, p, _, _ in token_tests(text))
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["cls", "p", "n"])

    table = bounded(documents).select("text").mapInPandas(trimmed(count), "cls long, p double, n long").groupBy("cls", "p").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("cls").orderBy("p")
    ranked = table.select("cls", "p", F.sum("n").over(upto).alias("k"), F.sum("n").over(Window.partitionBy("cls")).alias("m"))
    return {r.cls: r.p for r in ranked.where(F.col("p") <= F.lit(FDR) * F.col("k") / F.col("m")).groupBy("cls").agg(F.max("p").alias("p")).collect()}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def scan(text: str | None, cuts: dict[int, float] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed in ``KINDS``; ``cuts`` as in ``random_spans``."""
    if not text:
        return []
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base = list(spans)
    spans += [(a, b, 3) for a, b in random_spans(text, cuts) if not any(s <= a and b <= e for s, e, _ in base)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


def redact(text: str | None, spans) -> str | None:
    """The text with each span replaced by ``<secret>``; overlapping spans count as one."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def secrets(documents: DataFrame) -> DataFrame:
    cuts = corpus_cuts(documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                spans = scan(text, cuts)
                says = [f"{k}:{a}:{b}" for a, b, k in spans]
                base = [s for s, x in zip(says, spans) if x[2] != "random"]
                n = [sum(x[2] == k for x in spans) for k in KINDS]
                rows.append((*n[:3], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(says), n[3]))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]).assign(doc_id=longs(pdf["doc_id"]))

    return bounded(documents).select(as_text("doc_id"), "text").mapInPandas(
        trimmed(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every span redacted; n_chars, where present, follows the text."""
    names, cuts = documents.columns, corpus_cuts(documents)

    def run(batches):
        for b in batches:
            texts = [redact(t, scan(t, cuts)) for t in b["text"].to_pylist()]
            new = {"text": texts}
            if "n_chars" in names:
                new["n_chars"] = [len(t) if t is not None else n for t, n in zip(texts, b["n_chars"].to_pylist())]
            for name, values in new.items():
                field = b.schema.field(name)
                b = b.set_column(b.schema.get_field_index(name), field, pa.array(values, field.type))
            yield b

    return bounded(documents).mapInArrow(trimmed(run), documents.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
