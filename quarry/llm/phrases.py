"""Substring dedup by repeated-phrase automata.

A word is removed if a window of 13 words that covers it also starts in a document with a
smaller doc_id. The work goes through three exchanges, each linear in the corpus:

1. *Anchors.* Of the nine 5-word grams of a window the one with the smallest hash is its anchor,
   so equal windows have equal anchors, and a text has far fewer anchors than windows. Every
   task sends its distinct anchors, packed, to hash shards, which answer with those that more
   than one document has, and which of these are hot: in ``HOT_DOCS`` documents of one sender, or
   from ``HOT_SENDERS`` senders. (An anchor that very many documents have is sent once per task
   and block of documents.)
2. *Passages.* Around every recurring anchor the windows that have it form a short passage. A
   block sends each of its distinct passages, as text, with the smallest and largest doc_id that
   has it, to the anchor's shard; of a hot anchor it sends every window by itself, dealt by the
   window's own hash, so a phrase that half of the documents have does not gather its contexts in
   one place. Rows arrive sorted, and a shard holds no more of them than one automaton takes and
   one anchor adds. It confirms the windows that two documents share and compiles them into an
   Aho-Corasick automaton over word numbers; the passages of all documents with those anchors
   (not their whole texts) are streamed through it, and every occurrence is given the smallest
   doc_id that has it.
3. *Removal.* Blocks get these back under the MD5 of the passages and mark the covered words.

Blocks of documents are ranges of doc_id with literal limits, so a task that runs again sees the
same blocks. Hashes only choose candidates; what is removed was matched word by word.

Defined results: a null text has no words; rows with a null doc_id neither remove nor lose words
and are dealt to all blocks by a hash of the text;
repeated rows are all returned (a document's own copy under the same id is not a smaller id);
an empty table gives an empty result. Whole texts are used. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounds_of, bucket_of, chunks, partitions, ready, utf8, window_hashes, word_hashes

WINDOW, GRAM = 13, 5
#: Windows compiled into one automaton, anchors a task gathers before it sends them.
AUTOMATON, GATHER = 50_000, 2_000_000
BLOCKS_PER_PARTITION = 4
#: An anchor is hot if one sender has it in so many documents, or so many senders have it.
HOT_DOCS, HOT_SENDERS = 16, 256
#: The lowest bits of anchor hashes are flags: in several documents, hot.
_TWICE, _HOT = np.uint64(1), np.uint64(2)
_FLAGS = _TWICE | _HOT
_PASSAGE = "shard int, lot bigint, block int, anchor bigint, hot boolean, low bigint, top bigint, words binary"


def _anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the word hashes: its anchor's hash and place (the leftmost smallest
    gram). The lowest bits of anchor hashes are left for flags."""
    v = window_hashes(h, GRAM) & ~_FLAGS
    if len(v) < WINDOW - GRAM + 1:
        return v[:0], np.empty(0, np.int64)
    at = np.arange(len(v))
    width, need = 1, WINDOW - GRAM + 1
    while width < need:
        step = min(width, need - width)
        right = v[step:] < v[: len(v) - step]
        v, at = np.where(right, v[step:], v[: len(v) - step]), np.where(right, at[step:], at[: len(at) - step])
        width += step
    return v, at


class _Part:
    """The windows of a run of whole texts: anchor, place and owner of each."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.s, self.e, h = word_hashes(buf)
        self.first = np.searchsorted(self.s, at)
        v, place = _anchors(h)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(self.first))[: len(v)]
        self.start = np.flatnonzero(np.arange(len(v)) + WINDOW <= self.first[owner + 1]) if len(v) else np.empty(0, np.int64)
        self.anchor, self.place, self.owner = v[self.start], place[self.start], owner[self.start]

    def passages(self, wanted: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, bool, int, int]]:
        """(text, anchor, hot, first window, last window) of the runs of windows with one anchor
        place whose anchor is wanted (sorted); of a hot anchor every window by itself."""
        if not len(self.start) or not len(wanted):
            return
        new = np.flatnonzero((np.diff(self.place) != 0) | (np.diff(self.owner) != 0)) + 1
        a = np.concatenate([[0], new])
        b = np.concatenate([new, [len(self.start)]]) - 1
        k = np.searchsorted(wanted, self.anchor[a])
        hit = wanted[np.minimum(k, len(wanted) - 1)] == self.anchor[a]
        a, b, warm = a[hit], b[hit], hot[k[hit]]
        for owner, anchor, single, first, last in zip(self.owner[a].tolist(), self.anchor[a].view(np.int64).tolist(), warm.tolist(),
                                                      self.start[a].tolist(), self.start[b].tolist()):
            if single:
                for w in range(first, last + 1):
                    yield owner, anchor, True, w, w
            else:
                yield owner, anchor, False, first, last


def _send_anchors(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, lists in held.items():
                value, times = np.unique(np.concatenate(lists), return_counts=True)
                value |= (times > 1).astype(np.uint64) | (times >= HOT_DOCS).astype(np.uint64) * _HOT
                shard = ((value >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                value, shard = value[order], shard[order]
                cut = np.flatnonzero(np.diff(shard)) + 1
                ids = shard[np.concatenate([[0], cut])] if len(shard) else shard
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int32()), pa.array(np.full(len(ids), block), pa.int32()),
                     pa.array([x.tobytes() for x in np.split(value, cut)][: len(ids)], pa.binary())], ["shard", "block", "anchors"])
            held.clear()

        for b in batches:
            block = b.column("block").to_pylist()
            known = b.column("doc_id").is_valid().to_pylist()
            for i, j, buf, at in chunks(utf8(b.column("text"))):
                part = _Part(buf, at)
                if not len(part.start):
                    continue
                bounds = np.searchsorted(part.owner, np.arange(j - i + 1))
                for d in range(j - i):
                    if known[i + d] and bounds[d] < bounds[d + 1]:
                        own = np.unique(part.anchor[bounds[d]: bounds[d + 1]])
                        held.setdefault(block[i + d], []).append(own)
                        n += len(own)
            if n >= GATHER:
                yield from flush()
                n = 0
        yield from flush()

    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's answer: to every block, its anchors that more than one document has."""
    block, lists = [], []
    for b in batches:
        block += b.column("block").to_pylist()
        lists += [np.frombuffer(x, np.uint64) for x in b.column("anchors").to_pylist()]
    if not lists:
        return
    every = np.concatenate(lists)
    sender = np.repeat(np.asarray(block, np.int32), [len(x) for x in lists])
    del lists
    order = np.argsort(every, kind="stable")
    value, sender = every[order], sender[order]
    key = value & ~_FLAGS
    same = key[1:] == key[:-1]
    more = (value & _TWICE).astype(bool)  # twice among one sender's documents
    more[1:] |= same
    more[:-1] |= same
    # a flag on one entry holds for the equal ones, which the neighbour test has marked already
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    warm = (np.logical_or.reduceat((value & _HOT) > 0, first) | (times >= HOT_SENDERS)) if len(key) else np.empty(0, bool)
    key = key | np.repeat(warm, times).astype(np.uint64) * _HOT
    key, sender = key[more], sender[more]
    order = np.lexsort((key, sender))
    key, sender = key[order], sender[order]
    cut = np.flatnonzero(np.diff(sender)) + 1
    ids = sender[np.concatenate([[0], cut])] if len(sender) else sender
    for x, lot in zip(ids.tolist(), np.split(key, cut)):
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([np.unique(lot).tobytes()], pa.binary())], ["block", "anchors"])


def _passage_text(buf: np.ndarray, part: _Part, a: int, b: int) -> bytes:
    """The words of windows a to b, joined by one space."""
    return b" ".join(buf[part.s[a]: part.e[b + WINDOW - 1]].tobytes().split())


def _send_passages(shards: int):
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        lots = [np.frombuffer(x, np.uint64) for x in anchors.column("anchors").to_pylist()]
        wanted = np.unique(np.concatenate(lots)) if lots else np.empty(0, np.uint64)
        hot, wanted = (wanted & _HOT) > 0, wanted & ~_FLAGS
        found: dict[bytes, list] = {}
        if len(wanted) and docs.num_rows:
            ids, texts = docs.column("doc_id").to_pylist(), utf8(docs.column("text"))
            for i, _, buf, at in chunks(texts):
                part = _Part(buf, at)
                for d, anchor, single, a, b in part.passages(wanted, hot):
                    doc = ids[i + d]
                    if doc is None:
                        continue
                    got = found.setdefault(_passage_text(buf, part, a, b), [doc, doc, anchor, single])
                    got[0], got[1] = min(got[0], doc), max(got[1], doc)
        key = np.array([x[2] for x in found.values()], np.int64)
        single = np.array([x[3] for x in found.values()], bool)
        lot = key.copy()  # what must meet: passages of an anchor, equal windows of a hot one
        lot[single] = [int.from_bytes(md5(t).digest()[:8], "little", signed=True) for t, x in found.items() if x[3]]
        shard = ((lot.view(np.uint64) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
        block = (docs if docs.num_rows else anchors).column("block")[0].as_py()
        return pa.table({"shard": pa.array(shard, pa.int32()), "lot": pa.array(lot), "block": pa.array([block] * len(found), pa.int32()),
                         "anchor": pa.array(key), "hot": pa.array(single),
                         "low": pa.array([x[0] for x in found.values()], pa.int64()),
                         "top": pa.array([x[1] for x in found.values()], pa.int64()),
                         "words": pa.array(list(found), pa.binary())})

    return run


def _locate(rows: list[tuple]) -> Iterator[tuple[int, int, bool, bytes, list[int]]]:
    """Of passages (lot, anchor, hot, block, low, top, words) with whole lots: (block, anchor, hot,
    key, smallest doc_id of every window) of those that have a window to remove."""
    import ahocorasick
    distinct: dict[bytes, list[int]] = {}  # smallest and largest doc_id of every passage
    for *_, low, top, words in rows:
        got = distinct.setdefault(words, [low, top])
        got[0], got[1] = min(got[0], low), max(got[1], top)
    number: dict[bytes, int] = {}
    texts = []
    ends: dict[tuple, list[int]] = {}  # and of every window
    for words, (low, top) in distinct.items():
        t = tuple([number.setdefault(w, len(number)) for w in words.split(b" ")])
        texts.append(t)
        for i in range(len(t) - WINDOW + 1):
            got = ends.setdefault(t[i: i + WINDOW], [low, top])
            if low < got[0]:
                got[0] = low
            if top > got[1]:
                got[1] = top
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, (low, top) in ends.items():
        if low < top:
            automaton.add_word(w, low)
    if not len(automaton):
        return
    automaton.make_automaton()
    firsts: dict[bytes, tuple[int, bytes, list[int]]] = {}
    for (words, (_, top)), t in zip(distinct.items(), texts):
        first = [top] * (len(t) - WINDOW + 1)
        for end, low in automaton.iter(t):
            first[end - WINDOW + 1] = low
        firsts[words] = min(first), md5(words).digest(), first
    for _, anchor, hot, block, _, top, words in rows:
        least, key, first = firsts[words]
        if least < top:
            yield block, anchor, hot, key, first


def _first_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lot: whole lots, as many as one automaton takes, are located together."""
    rows: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        got = list(_locate(rows))
        if got:
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.bool_()),
                 pa.array([g[3] for g in got], pa.binary()), pa.array([g[4] for g in got], pa.list_(pa.int64()))],
                ["block", "anchor", "hot", "key", "first"])
        rows.clear()

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("lot", "anchor", "hot", "block", "low", "top", "words"))):
            if len(rows) >= AUTOMATON // 5 and row[0] != rows[-1][0]:
                yield from flush()
            rows.append(row)
    if rows:
        yield from flush()


def _remove(docs: pa.Table, found: pa.Table) -> pa.Table:
    first = dict(zip(found.column("key").to_pylist(), found.column("first").to_pylist()))
    wanted, at = np.unique(found.column("anchor").to_numpy().astype(np.int64).view(np.uint64), return_index=True) if found.num_rows \
        else (np.empty(0, np.uint64), np.empty(0, np.int64))
    hot = found.column("hot").to_numpy(zero_copy_only=False).astype(bool)[at]
    ids, texts = docs.column("doc_id").to_pylist(), utf8(docs.column("text"))
    words, removed, digest = [], [], []
    for i, j, buf, at in chunks(texts):
        part = _Part(buf, at)
        gone = np.zeros(len(part.s) + 1, np.int32)
        hit = set()
        for d, _, _, a, b in part.passages(wanted, hot):
            doc = ids[i + d]
            known = first.get(md5(_passage_text(buf, part, a, b)).digest()) if doc is not None else None
            if known is not None:
                for k, low in enumerate(known):
                    if low < doc:
                        gone[a + k] += 1
                        gone[a + k + WINDOW] -= 1
                        hit.add(d)
        keep = np.cumsum(gone[:-1]) == 0
        for d in range(j - i):
            w = texts[i + d].split()
            lo, hi = part.first[d], part.first[d + 1]
            if d in hit:
                w = [w[k] for k in np.flatnonzero(keep[lo:hi]).tolist()]
            words.append(int(hi - lo))
            removed.append(int(hi - lo) - len(w))
            digest.append(sha256(b" ".join(w)).hexdigest())
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(words, pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    spark = ready(docs.sparkSession)
    n = partitions(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = bounds_of(docs.select("doc_id"), "doc_id", n * BLOCKS_PER_PARTITION)
    block = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(len(cuts) + 1))).otherwise(
        bucket_of(F.col("doc_id").cast("long"), cuts))
    d = docs.select(block.cast("int").alias("block"), "doc_id", "text")
    recurring = d.mapInArrow(_send_anchors(n), "shard int, block int, anchors binary") \
        .repartitionById(n, F.col("shard")).mapInArrow(_recurring, "block int, anchors binary")
    passages = d.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(_send_passages(n), _PASSAGE)
    found = passages.repartitionById(n, F.col("shard")).sortWithinPartitions("lot").mapInArrow(
        _first_documents, "block int, anchor bigint, hot boolean, key binary, first array<bigint>")
    return d.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def op9(docs: DataFrame) -> DataFrame:
    return dedup(docs)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
      FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE low < doc_id),
x AS (SELECT DISTINCT rid, i + j AS p FROM m, (SELECT unnest(range(0, 13)) AS j)),
w AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT w.rid, count(x.p) AS n_removed,
        coalesce(string_agg(CASE WHEN x.p IS NULL THEN word END, ' ' ORDER BY w.p), '') AS kept
      FROM w LEFT JOIN x ON w.rid = x.rid AND w.p = x.p GROUP BY w.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
