"""Secret scans: fixed patterns plus a randomness test battery.

Base spans come from three patterns. The method adds spans of kind ``random``: maximal runs
of token characters, 20 or more, and their parts between ``/ + - _`` of the same length, that
do not overlap a base span (a part only where its run is not taken as a whole). For each the
encoding is inferred, the smallest alphabet of ``ALPHABETS`` that holds every character, and
three tests are run against random characters of that encoding, each two-sided:

* uniformity: chi-squared of the counts of all characters of the alphabet;
* serial correlation: of neighbouring characters' places in the alphabet;
* runs: the number of changes between the alphabet's classes (lower, upper, digit or mark), or
  between its halves where it has one class.

A candidate that any of them rejects at ``ALPHA`` is not random. Their power grows with length:
long words and phrases repeat letters too often, keyboard rows and counters too seldom. What
passes, which short words can, has to be unlike words as well, whose rates are fixed values below:
fewer repeats of letters (the chi-squared of the letters against a normal approximation of the
one that words have), more class changes, fewer vowel changes, and more letters that are rare in
each of two groups of languages (binomial counts). These p-values, which fall with length by themselves, are combined by Fisher's
method, those left out that an encoding cannot show (hexadecimal: letters; one class: class
changes), and go through Benjamini-Hochberg control over the document's candidates.

Defined results: null and empty texts have no span; repeated rows are all returned; an empty
table gives an empty result. Whole texts are scanned, whatever their length. Only ``doc_id``
and ``text`` are read by the scan; ``redact`` keeps every column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, ready, utf8

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

MIN_RANDOM = 20
#: Level of the three tests of randomness, false-discovery rate; in word-like text
#: class changes per pair (several cases, one case and digits), vowel changes per pair of
#: letters, rare letters per letter, chi-squared of the letters beyond its degrees of freedom per letter.
ALPHA, FDR = 0.001, 0.001
WORDLIKE_CHANGES, ONE_CASE_CHANGES, VOWEL_CHANGES, RARE_LETTERS, WORD_CHI = 0.15, 0.1, 0.55, 0.08, 0.6
_LOW, _UP, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
ALPHABETS = (b"0123456789abcdef", b"0123456789ABCDEF", _LOW, _UP, _UP + b"234567", _LOW + b"234567",
             _LOW + _DIGITS, _UP + _DIGITS, _UP + _LOW, _UP + _LOW + _DIGITS,
             _UP + _LOW + _DIGITS + b"+/", _UP + _LOW + _DIGITS + b"-_")
_HEXES = 2
_SEPARATORS = (re.compile(rb"[^/]+"), re.compile(rb"[^/+]+"), re.compile(rb"[^/+_-]+"))

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-")] = True
_CLASS = np.full(256, 2, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_VOWEL, _LETTER = (np.isin(np.arange(256), list(x + x.upper())) for x in (b"aeiouy", _LOW))
#: Letters that are rare in words of English, German and Romance languages, and of Slavic ones;
#: together less than RARE_LETTERS.
RARE = (b"jkqvwxyz", b"bfghjqvx")
_RARE = np.array([np.isin(np.arange(256), list(x + x.upper())) for x in RARE])
_PLACES = []
for _a in ALPHABETS:
    _t = np.full(256, -1, np.int16)
    _t[list(_a)] = np.arange(len(_a))
    _PLACES.append(_t)


def _chi2_tail(x: float, odd_df: int) -> float:
    """Upper tail of chi-squared for odd degrees of freedom (series in closed form)."""
    tail = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, (odd_df - 1) // 2 + 1):
        tail += term
        term *= x / (2 * k + 1)
    return tail


def _binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    wide = 400 + int(10 * math.sqrt(n * p))
    if k < n * p - wide:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq)
                        for i in range(k, min(n, max(k, int(n * p)) + wide) + 1)))


def _runs(at: np.ndarray, places: np.ndarray, size: int) -> float:
    """Two-sided p-value of the number of class changes in random characters of the alphabet."""
    alphabet = np.flatnonzero(places >= 0)
    group = np.zeros(size, np.int64)
    group[places[alphabet]] = _CLASS[alphabet]
    if len(set(group.tolist())) == 1:
        group = np.arange(size) * 2 // size
    share = np.bincount(group) / size
    change = 1 - float((share ** 2).sum())
    both = float((share * (1 - share) ** 2).sum())  # two changes in a row
    n = len(at)
    var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change ** 2)
    seen = int((group[at][1:] != group[at][:-1]).sum())
    return math.erfc(abs(seen - (n - 1) * change) / math.sqrt(2 * var))


def battery(token: bytes) -> tuple[float, float, float, float] | None:
    """p-values of (uniformity, serial correlation, runs, word-like text); None without an encoding."""
    b = np.frombuffer(token, np.uint8)
    for code, places in enumerate(_PLACES):
        at = places[b]
        if at.min() >= 0:
            break
    else:
        return None
    size, n = int(places.max()) + 1, len(b)
    seen = np.bincount(at, minlength=size).astype(float)
    above = min(1.0, _chi2_tail(float((seen ** 2).sum()) * size / n - n, size - 1))
    uniform = min(1.0, 2 * min(above, 1 - above))
    x = at - at.mean()
    var = float((x * x).sum())
    if var == 0:
        return 0.0, 0.0, 0.0, 1.0
    r = float((x[:-1] * x[1:]).sum()) / var
    serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return uniform, serial, _runs(at, places, size), _unlike_words(b, code)


def _unlike_words(b: np.ndarray, code: int) -> float:
    """Fisher's combination of the word-like tests that the encoding allows."""
    kinds, letter = _CLASS[b], _LETTER[b]
    present, p = set(kinds.tolist()), []
    if len(present) > 1:
        rate = WORDLIKE_CHANGES if {0, 1} <= present else ONE_CASE_CHANGES
        p.append(_binomial_tail(int((kinds[1:] != kinds[:-1]).sum()), len(b) - 1, rate))
    if code >= _HEXES:
        pair = letter[1:] & letter[:-1]
        vowel = _VOWEL[b]
        m, changes = int(pair.sum()), int((pair & (vowel[1:] != vowel[:-1])).sum())
        p.append(_binomial_tail(m - changes, m, 1 - VOWEL_CHANGES))
        letters = int(letter.sum())
        if letters > 1:
            seen = np.bincount(b[letter] | 32, minlength=256).astype(float)
            x2 = float((seen ** 2).sum()) * 26 / letters - letters
            mean, var = 25 + WORD_CHI * letters, 50 + 4 * WORD_CHI * letters
            p.append(0.5 * math.erfc((mean - x2) / math.sqrt(2 * var)))
        # unlike both groups: the fewer rare letters count
        p.append(_binomial_tail(int(_RARE[:, b].sum(1).min()), letters, RARE_LETTERS))
    half = -sum(math.log(max(x, 1e-300)) for x in p)  # chi-squared with 2 len(p) degrees, halved
    return math.exp(-half) * sum(half ** k / math.factorial(k) for k in range(len(p))) if p else 1.0


def discoveries(tokens: list[bytes]) -> list[int]:
    """Indexes of the tokens taken as random, in order."""
    p = []
    for i, t in enumerate(tokens):
        got = battery(t)
        p.append((got[3] if got and min(got[:3]) >= ALPHA else 1.0, i))
    p.sort()
    last = max((k for k, (x, _) in enumerate(p, 1) if x <= FDR * k / len(p)), default=0)
    return sorted(i for _, i in p[:last])


def _assigns(t: bytes) -> list[tuple[int, int]]:
    low = t.lower()
    starts = []
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            starts.append(at)
            at = low.find(word, at + 1)
    out, end = [], 0
    for s in sorted(starts):
        if s >= end and (m := ASSIGN.match(t, s)):
            end = m.end()
            if len(m[2]) >= MIN_ASSIGN:
                out.append((s, end))
    return out


def _parts(t: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs and their long parts between separators."""
    out = dict.fromkeys(runs)
    for a, b in runs:
        for pattern in _SEPARATORS:
            out.update(dict.fromkeys(m.span() for m in pattern.finditer(t, a, b) if m.end() - m.start() >= MIN_RANDOM))
    return list(out)


def spans(t: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """All spans of one text in code points by start, then kind. ``runs``: its maximal runs
    of token characters of 20 bytes or more (every hex and access span lies in one)."""
    found = [(a, b, 0) for a, b in _assigns(t)]
    for a, b in runs:
        for kind, pattern, least in ((1, ACCESS, MIN_ACCESS), (2, HEX, MIN_HEX)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(t, a, b) if m.end() - m.start() >= least]
    free = [(a, b) for a, b in _parts(t, runs) if all(b <= x or a >= y for x, y, _ in found)]
    end = -1
    for a, b in sorted((free[i] for i in discoveries([t[a:b] for a, b in free])), key=lambda x: (x[0], -x[1])):
        if a >= end:  # the longest of nested ones
            found.append((a, b, 3))
            end = b
    found.sort(key=lambda x: (x[0], x[2]))
    if found and not t.isascii():  # byte offsets to code points, one pass
        cps = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
        found = [(int(cps[a]), int(cps[b]), k) for a, b, k in found]
    return [(a, b, KINDS[k]) for a, b, k in found]


def batch_spans(texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
    out = []
    for i, j, buf, at in chunks(texts):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _TOKEN[buf], [False]])))
        s, e = edge[0::2], edge[1::2]
        long = e - s >= MIN_RANDOM
        s, e = s[long], e[long]
        first = np.searchsorted(s, at)
        for d in range(j - i):
            lo, hi = first[d], first[d + 1]
            out.append(spans(texts[i + d], list(zip((s[lo:hi] - at[d]).tolist(), (e[lo:hi] - at[d]).tolist()))))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: array of (start, end, kind), no shuffle."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[dict(zip(("start", "end", "kind"), x)) for x in f] for f in batch_spans(utf8(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.list_(item))], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, found array<struct<start: bigint, end: bigint, kind: string>>")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with every span of ``text`` replaced by ``[kind]``
    (overlapping spans as one, under the first's kind) and ``n_chars``, where there is such
    a column, counted again. A null text stays null."""
    ready(docs.sparkSession)
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(text).to_pylist()
            new = []
            for t, found in zip(old, batch_spans(utf8(b.column(text)))):
                parts, end = [], 0
                for a, z, kind in found:
                    if a >= end:
                        parts += [t[end:a], f"[{kind}]"]
                    end = max(end, z)
                new.append("".join([*parts, t[end:]]) if found else t)
            cols = list(b.columns)
            cols[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*names)
    return out


def op10(docs: DataFrame) -> DataFrame:
    f = F.col("found")

    def only(kind: str):
        return lambda x: x["kind"] == kind

    def listed(found):
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    many = [F.size(F.filter(f, only(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = listed(F.filter(f, lambda x: x["kind"] != "random"))
    return scan(docs).select("doc_id", *many, F.sha2(base, 256).alias("base_sha256"), listed(f).alias("spans"))
