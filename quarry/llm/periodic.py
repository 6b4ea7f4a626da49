"""Periodic runs of words, found by descending-LCP Kruskal.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
``shortest`` words and two periods that no neighbouring word extends. Of a run (s, e, q) the
suffixes at s and s + q share a prefix of e - s - q >= max(shortest - q, q) words, so only
positions whose next ``shortest / 2`` words occur twice in their text take part. Their suffixes
are sorted (prefix doubling), neighbours get their LCP (Kasai), and the LCPs are taken in
descending order as edges of a spanning tree: union-find joins the classes of suffixes, each
kept as an ordered set of positions, the smaller into the larger. Positions i < j that become
neighbours in a set at LCP l with j - i <= l are a run of period j - i and j - i + l words, if
the words before i and j differ. (A smaller period would divide j - i and have united a position
between them at a higher LCP; equal LCPs in any order do no harm for the same reason.)

A text is one task's work, as one row; a text of n words takes O(n log^2 n). Words are compared
as themselves, not as hashes.

Defined results: null and empty texts, and texts without a word, have no run and an empty
collapsed text; every row, repeated or with a null doc_id, gives one row; of runs of equal length
the one with the smallest start, then period, is the longest; an empty table gives an empty
result. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ready, utf8

SHORTEST = 12
_BLOCK = 2048
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Positions:
    """An ordered set of positions in blocks of bounded length, with a number for its class."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def around(self, x: int) -> tuple[int, int]:
        """The nearest positions below and above x, which is not in the set; -1 for none."""
        k = self._block(x)
        b = self.blocks[k]
        i = bisect_left(b, x)
        below = b[i - 1] if i else self.blocks[k - 1][-1] if k else -1
        above = b[i] if i < len(b) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return below, above

    def add(self, x: int) -> None:
        k = self._block(x)
        b = self.blocks[k]
        b.insert(bisect_left(b, x), x)
        self.size += 1
        if len(b) > _BLOCK:
            self.blocks[k: k + 1] = [b[: _BLOCK // 2], b[_BLOCK // 2:]]

    def _block(self, x: int) -> int:
        """The block that x belongs in: the last one that begins at or before it."""
        if len(self.blocks) == 1:
            return 0
        return max(0, bisect_left(self.blocks, x, key=lambda b: b[0]) - 1)


def joined(large: Positions, small: Positions) -> list[tuple[int, int]]:
    """Adds ``small`` to ``large`` and returns the pairs that are neighbours only now: at each
    gap of ``large`` the first and the last new position with the gap's ends."""
    pairs, before, gap = [], -1, (-2, -2)
    for x in small:
        here = large.around(x)
        if here != gap:
            if before >= 0 and gap[1] >= 0:
                pairs.append((before, gap[1]))
            if here[0] >= 0:
                pairs.append((here[0], x))
        before, gap = x, here
    if gap[1] >= 0:
        pairs.append((before, gap[1]))
    for x in small:
        large.add(x)
    return pairs


def suffix_order(w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions in the order of their suffixes, as far as needed, and a flag per place:
    the position shares its first k words with the one before it."""
    n = len(w)
    padded = np.concatenate([w, np.full(k, -1, w.dtype)])
    order = np.lexsort([padded[j: j + n] for j in range(k - 1, -1, -1)])
    new = np.ones(n, bool)
    new[1:] = np.any([padded[order[1:] + j] != padded[order[:-1] + j] for j in range(k)], axis=0)
    # a suffix of fewer than k words is no prefix of k words
    new[order > n - k] = True
    new[1:][order[:-1] > n - k] = True
    same = ~new
    rank = np.full(2 * n + 1, -1, np.int64)
    while True:
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = start
        many = ~new
        many[:-1] |= ~new[1:]
        at = np.flatnonzero(many)
        if not len(at):
            return order, same
        pos = order[at]
        second = rank[np.minimum(pos + k, 2 * n)]
        by = np.lexsort((second, start[at]))
        order[at] = pos[by]
        second, group = second[by], start[at]
        split = np.ones(len(at), bool)
        split[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[at] |= split
        k *= 2


def shared_prefixes(w: list[int], order: np.ndarray, same: np.ndarray, k: int) -> tuple[list, list, list]:
    """(i, j, words in common) of the suffixes that share at least k words with the one before."""
    place = np.flatnonzero(same)
    left, right = order[place - 1], order[place]
    by = np.argsort(right)  # in text order an LCP falls by one word at most
    lefts, rights, out, n, h, last = left[by].tolist(), right[by].tolist(), [], len(w), 0, -2
    for i, j in zip(lefts, rights):
        h = max(h - 1, k) if j == last + 1 else k
        end = n - max(i, j)
        while h < end and w[i + h] == w[j + h]:
            h += 1
        last = j
        out.append(h)
    return lefts, rights, out


def find_runs(words: list, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, k = len(words), (shortest + 1) // 2
    if n < shortest:
        return []
    seen: dict = {}
    w = np.array([seen.setdefault(x, len(seen)) for x in words], np.int64)
    if len(seen) == n:
        return []
    h = np.zeros(n - k + 1, np.uint64)  # only to see that no k words occur twice
    spread = w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    for j in range(k):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + spread[j: j + n - k + 1]
    h.sort()
    if not (h[1:] == h[:-1]).any():
        return []
    order, same = suffix_order(w, k)
    w = w.tolist()
    lefts, rights, lcp = shared_prefixes(w, order, same, k)
    owner: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def root(x: int) -> int:
        top = x
        while (up := owner.get(top, top)) != top:
            top = up
        while (up := owner.get(x, x)) != top:
            owner[x], x = top, up
        return top

    found = []
    for e in np.argsort(-np.array(lcp, np.int64), kind="stable").tolist():
        ll, a, b = lcp[e], root(lefts[e]), root(rights[e])
        large, small = sets.pop(a, None) or Positions(a), sets.pop(b, None) or Positions(b)
        if large.size < small.size:
            large, small, a, b = small, large, b, a
        owner[b] = a
        for i, j in joined(large, small):
            q = j - i
            if q <= ll and q + ll >= shortest and (i == 0 or w[i - 1] != w[j - 1]):
                found.append((i, q + ll, q))
        sets[a] = large
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that follow the first period of a run that contains them."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST,
                  edit: Callable[[object, list], list] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, ``runs`` (start, length and period, by start, then
    period) and ``collapsed`` (the words that no run repeats, joined by a space). ``edit`` maps
    (doc_id, words) to the words to search instead."""
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, runs, texts = [], [], []
            for key, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
                words = text.split()
                if edit is not None:
                    words = edit(key, words)
                found = find_runs(words, shortest)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, _RUNS),
                 pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def repeat_tail(doc_id: object, words: list) -> list:
    """The query's edited words: for one document in ten a tail repeats with a period. A row with
    a null doc_id keeps its words."""
    n = len(words)
    if doc_id is None or not n or (h := crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, edit=repeat_tail)
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q")))), F.lit(0))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"), F.col("best.q").alias("period"),
        F.expr("(-1000 * best.l) div best.q").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


#: The same rows in DuckDB: stretches of equal words q apart from the pairs of equal six words,
#: without those whose period is a multiple of a covering one.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0 FROM documents),
c AS (SELECT *, len(w0)::BIGINT AS n, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
            lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: xor(xor(a, greatest(x, 0)) >> 1, 3988292384 * (xor(a, greatest(x, 0)) & 1)))) AS h FROM d),
e AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM c),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
t AS (SELECT doc_id, rid, n, list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) AS w FROM f),
g AS (SELECT rid, i, hash(list_slice(w, i + 1, i + 6)) AS g FROM (SELECT rid, w, unnest(range(n - 5)) AS i FROM t)),
k AS (SELECT rid, i, g FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
pair AS (SELECT x.rid, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.rid = y.rid AND x.g = y.g AND x.i < y.i),
isle AS (SELECT rid, q, min(i) AS s, count(*) + 5 AS l FROM (
        SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS part FROM pair) GROUP BY rid, q, part),
maybe AS (SELECT rid, s, l + q AS len, q FROM isle WHERE l >= q AND l + q >= 12),
run AS (SELECT * FROM maybe r WHERE NOT EXISTS (SELECT 1 FROM maybe o WHERE o.rid = r.rid AND o.q < r.q AND r.q % o.q = 0
        AND o.s <= r.s AND o.s + o.len >= r.s + r.len)),
gone AS (SELECT rid, list(DISTINCT i) AS gone FROM (SELECT rid, unnest(range(s + q, s + len)) AS i FROM run) GROUP BY rid),
agg AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
        first(struct_pack(s := s, l := len, q := q) ORDER BY len DESC, s, q) AS best FROM run GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
           list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN agg USING (rid) LEFT JOIN gone USING (rid)
"""
