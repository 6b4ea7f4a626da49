"""Conversation prefix trie by truncation peeling.

A conversation is one row: the digests of its turns in order (16 bytes a turn), and the code
points of each. Conversations are range-sorted by their digests, so the members of a node (a
sequence of first turns) are neighbours, and every task takes slices of bounded size, whatever
turns are frequent. A slice is peeled from its maximum depth down: conversations that end at a
depth join the nodes that survive from below, all are regrouped by their turns up to that depth,
a node's figures are finished, its last turn is stripped, and what is left is regrouped one
depth higher. Only nodes on the paths of a slice's first and last conversation can have members
in other slices. Those stay open: the two paths, with what closed nodes add to each depth of
them, are the items of the next round, peeled the same way. A slice has at least 16 items, so a
round leaves an eighth of the items at most, and the last few are peeled as one slice.

Text leaves a task only as digests and counts. The ids that end at a node are hashed in ascending
order in a stream; only for open nodes do they pass through a second exchange, packed by slice.

Defined results: turns are ordered by turn number, null first, ties by the digest of role and
text; null roles and texts are empty; repeated rows are turns of their own; rows with a null
conv_id are left out; a conversation whose base has no rows keeps only its own turns after the
head; an empty table has no node. Only conv_id, turn, role and text are read, so other columns
cannot clash. A conversation's digests must fit a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ready

#: Digest bytes of a turn; turns and items that a slice gathers; items it has at least.
DIGEST, SLICE, LEAST = 16, 1 << 16, 16
_NO_ENDS = sha256(b"").hexdigest()

_ITEM = "chain binary, cps array<int>, conv bigint, at array<int>, sums array<array<bigint>>"
_NODE = ("key binary, up binary, depth int, least bigint, parent bigint, n bigint, children bigint, leaves bigint, "
         "saved bigint, ends string")
_OUT = f"kind int, {_ITEM}, {_NODE}, ids string"
_NODES, _OPEN, _ENDS = 0, 1, 2


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and ``l``, its turns in order as (digest, code points)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", digest.alias("d"), F.length(text).alias("cp")).alias("t")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("l")) \
        .select("conv_id", F.transform("l", lambda t: F.struct(t["d"].alias("d"), t["cp"].alias("cp"))).alias("l"))


def share_heads(seq: DataFrame, bases: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """The sequences with their first ``head`` (at most ``most``) turns taken from the sequence of
    conversation ``base`` among ``bases``, as far as it has them."""
    heads = bases.select(F.col("conv_id").alias("base"), F.slice("l", 1, most).alias("head"))
    first = F.slice(F.coalesce("head", F.array().cast(seq.schema["l"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("l", F.col("h") + 1, F.greatest(F.size("l"), F.lit(1)))
    return seq.withColumn("base", base).withColumn("h", head).join(heads, "base", "left") \
        .select("conv_id", F.concat(first, rest).alias("l"))


class _Node:
    __slots__ = ("item", "n", "least", "children", "leaves", "saved", "ends", "below")

    def __init__(self, item: _Item):
        self.item, self.n, self.least, self.children, self.leaves, self.saved = item, 0, None, 0, 0, 0
        self.ends: list[int] = []
        self.below: list[dict] = []

    def add(self, n: int, least: int, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved


class _Item:
    """A conversation, or an open path: its chain of digests and what it adds at depths ``at``."""

    __slots__ = ("chain", "cps", "conv", "keys", "at", "sums", "raw")

    def __init__(self, chain: bytes, cps: list[int], conv: int, at: list[int] | None, sums: list[list[int]] | None):
        self.chain, self.cps, self.conv, self.raw = chain, cps, conv, at is None
        self.at = [len(cps)] if at is None else at
        self.sums = [[1, conv, 0, 0, 0]] if sums is None else sums
        h = md5()
        self.keys = [h.digest()]
        for d in range(len(cps)):
            h.update(chain[DIGEST * d: DIGEST * (d + 1)])
            self.keys.append(h.digest())


def _hash_ids(ids: list[int]) -> str:
    return sha256(",".join(map(str, ids)).encode()).hexdigest()


def peel(items: list[_Item], last: bool) -> Iterator[dict]:
    """Rows of the closed nodes of a slice (sorted items), its open paths and the ids that end at
    open nodes; ``last``: the slice holds all items, so nothing stays open."""
    first_keys = {} if last else {k: d for d, k in enumerate(items[0].keys)}
    open_keys = first_keys if last else first_keys | {k: d for d, k in enumerate(items[-1].keys)}
    starting: dict[int, list[tuple[_Item, list[int]]]] = {}
    for item in items:
        for d, s in zip(item.at, item.sums):
            starting.setdefault(d, []).append((item, s))
    paths: tuple[list, list] = ([], [])
    alive: dict[bytes, _Node] = {}
    for d in range(max(starting), -1, -1):
        now: dict[bytes, _Node] = {}
        for item, s in starting.get(d, ()):  # what begins at this depth
            node = now.get(item.keys[d])
            if node is None:
                node = now[item.keys[d]] = _Node(item)
            node.add(*s)
            if item.raw:
                node.ends.append(item.conv)
        for key, node in alive.items():  # survivors, stripped of their last turn
            if key in open_keys:
                if node.item.keys[d] not in now:
                    now[node.item.keys[d]] = _Node(node.item)
                continue
            row = _row(key, node, d + 1)
            up = now.get(node.item.keys[d])
            if up is None:
                up = now[node.item.keys[d]] = _Node(node.item)
            up.add(node.n, node.least, 1, node.leaves, node.saved)
            up.below.append(row)
        for key, node in now.items():
            if key not in open_keys:
                if not node.children:
                    node.leaves = 1
                if d:
                    node.saved += (node.n - 1) * node.item.cps[d - 1]
                for row in node.below:
                    yield row | {"parent": node.least}
                node.below = []
                continue
            yield from node.below
            node.below = []
            if node.n:
                paths[0 if key in first_keys else 1].append((d, [node.n, node.least, node.children, node.leaves, node.saved]))
            if node.ends:
                yield {"kind": _ENDS, "key": key, "conv": node.ends[0], "ids": ",".join(map(str, node.ends))}
        alive = now
    if last:
        for key, node in alive.items():
            yield _row(key, node, 0)
    else:
        for item, path in zip((items[0], items[-1]), paths):
            if path:
                yield {"kind": _OPEN, "chain": item.chain, "cps": item.cps, "conv": item.conv,
                       "at": [d for d, _ in path], "sums": [s for _, s in path]}


def _row(key: bytes, node: _Node, depth: int) -> dict:
    return {"kind": _NODES, "key": key, "up": node.item.keys[depth - 1] if depth else None, "depth": depth, "least": node.least,
            "n": node.n, "children": node.children, "leaves": node.leaves, "saved": node.saved,
            "ends": _hash_ids(node.ends) if node.ends else None}


def _round(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("kind", pa.int32()), ("chain", pa.binary()), ("cps", pa.list_(pa.int32())), ("conv", pa.int64()),
                        ("at", pa.list_(pa.int32())), ("sums", pa.list_(pa.list_(pa.int64()))), ("key", pa.binary()),
                        ("up", pa.binary()), ("depth", pa.int32()), ("least", pa.int64()), ("parent", pa.int64()),
                        ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
                        ("ends", pa.string()), ("ids", pa.string())])

    def rows(items: list[_Item]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for row in peel(items, last):
            out.append(row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[_Item] = []
        size = 0
        for b in batches:
            for row in b.to_pylist():
                if size >= SLICE and len(items) >= LEAST and not last:
                    yield from rows(items)
                    items, size = [], 0
                items.append(_Item(row["chain"], row["cps"], row["conv"], row["at"], row["sums"]))
                size += 1 + len(row["cps"])
        if items:
            yield from rows(items)

    return run


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) from packed ids, sorted by key and first id."""
    key, h = None, None
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if h is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())],
                                         ["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends"])


def prefix_trie(seq: DataFrame) -> DataFrame:
    """One row per node of the trie of the sequences (conv_id, l): key (MD5 of the turns' digests),
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256."""
    ready(seq.sparkSession)
    items = seq.select(F.unhex(F.array_join(F.transform("l", lambda t: F.hex(t["d"])), "")).alias("chain"),
                       F.transform("l", lambda t: t["cp"]).alias("cps"), F.col("conv_id").alias("conv"),
                       F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<array<bigint>>").alias("sums"))
    items = items.checkpoint()  # the range bounds and the rows come from one evaluation
    rounds, last = [], False
    parts = items.repartitionByRange("chain", "conv")
    while True:
        out = parts.sortWithinPartitions("chain", "conv").mapInArrow(_round(last), _OUT).checkpoint()
        rounds.append(out)
        if last:
            break
        items = out.filter(F.col("kind") == _OPEN).select("chain", "cps", "conv", "at", "sums")
        n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.size("cps") + 1), F.lit(0))).first()
        if not n:
            break
        last = n <= LEAST or size <= SLICE
        few = last or n < 64 * LEAST
        parts = items.coalesce(1) if few else items.repartitionByRange(n // (16 * LEAST), "chain", "conv")
    early = rounds[0].filter(F.col("kind") == _NODES)
    late = rounds[0].limit(0)
    for out in rounds[1:]:
        late = late.unionByName(out.filter(F.col("kind") == _NODES))
    ends = rounds[0].filter(F.col("kind") == _ENDS).select("key", "conv", "ids").repartition("key") \
        .sortWithinPartitions("key", "conv").select("key", "ids").mapInArrow(_hash_parts, "key binary, ends string")
    names = ["key", "up", "depth", "least", "parent", "n", "children", "leaves", "saved"]
    late = late.select(*names).join(ends, "key", "left").select(*names, "ends").checkpoint()
    above = late.select(F.col("key").alias("up"), F.col("least").alias("found"))
    nodes = early.select(*names, "ends").unionByName(late)
    whole = nodes.filter("parent is not null or depth = 0").select(*names, "ends")
    rest = nodes.filter("parent is null and depth > 0").join(above, "up").withColumn("parent", F.col("found")).select(*names, "ends")
    return whole.unionByName(rest).select(
        "key", F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))


def op13(turns: DataFrame) -> DataFrame:
    seq, c = sequences(turns), F.col("conv_id")
    head = F.expr("cast(crc32(cast(conv_id as string)) % 6 as int)")
    return prefix_trie(share_heads(seq, seq.filter(c % 100 == 0), c - c % 100, head, 5)).drop("key")


#: The same rows in DuckDB.
SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
            lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: xor(xor(a, greatest(x, 0)) >> 1, 3988292384 * (xor(a, greatest(x, 0)) & 1)))) % 6 AS h
        FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT ids.c, i, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND i <= h
      UNION ALL SELECT ids.c, i, role, text FROM ids JOIN t ON t.c = ids.c AND i > h),
s AS (SELECT c, row_number() OVER o AS d, length(text) AS cp,
        string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING) AS k
      FROM u WINDOW o AS (PARTITION BY c ORDER BY i)),
m AS (SELECT c, d, cp, k FROM s UNION ALL SELECT c, 0, 0, '' FROM ids),
z AS (SELECT c, max(d) AS z FROM m GROUP BY c),
n AS (SELECT d, k, min(m.c) AS c, count(*) AS n, any_value(cp) AS cp, substr(k, 1, 32 * (d - 1)) AS up,
        coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE d = z), '') AS ends
      FROM m JOIN z ON m.c = z.c GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
b AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k),
x AS (SELECT m.d, m.k, sum((b.n - 1) * b.cp) AS saved, sum((b.children = 0)::INT) AS leaves
      FROM b JOIN m ON m.c = b.c AND m.d <= b.d GROUP BY m.d, m.k)
SELECT b.c AS conv_id, b.d::BIGINT AS depth, p.c AS parent_conv_id, b.n::BIGINT AS n_convs, b.children::BIGINT AS n_children,
       x.leaves::BIGINT AS n_leaves, x.saved::BIGINT AS saved_tokens, sha256(b.ends) AS ends_sha256
FROM b JOIN x ON x.d = b.d AND x.k = b.k LEFT JOIN b p ON p.d = b.d - 1 AND p.k = b.up
"""
