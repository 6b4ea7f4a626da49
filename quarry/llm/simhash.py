"""SimHash near-duplicate detection by a segment-popcount grid.

A 64-bit fingerprint is embedded as 16 numbers: the bit counts of its 4-bit segments. The
Manhattan distance of two embeddings is a lower bound of the Hamming distance, so pairs at
Hamming distance <= 2 lie within Manhattan distance 2, and two such points have a lattice
point within distance 1 of both. The range join is therefore an equality join on the cells
within distance 1 (33 per fingerprint). Cells with a single fingerprint end there. In the
others the exact check follows, without comparing all pairs of a crowded cell: two
fingerprints are within Hamming distance 2 exactly if some 64-bit value is within distance 1
of both, and that value lies in a shared cell; fingerprints are grouped by those values (at
most 65 distinct ones can meet at a value). Links found this way are exact; components follow.

Defined results: null and empty texts, and texts without a word, have fingerprint zero, which
links like any other; repeated rows are all returned; an empty table gives an empty result;
a null doc_id row is returned with its component's smallest id (null if it has none). Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import numbered, ready, utf8, written
from quarry.llm.components import components

SEED = 42
SEGMENTS, WIDTH = 16, 4
_BLOCK = 1 << 15


def fingerprint(text: bytes, k: int) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 hashes of the k-word shingles
    (repeats counted) of the text with A-Z lower-cased."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - k + 1)
    grams = map(b" ".join, zip(*(w[j:] for j in range(k)))) if len(w) >= k else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = h[i: i + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in utf8(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _ones(fp: Column, width: int = WIDTH) -> Column:
    """The bit counts of the segments of ``width`` bits, each in its segment's place. (Two-bit
    segments are for fingerprints of up to 62 bits: no sum reaches the sign bit.)"""
    mask = F.lit(int(("0" * (width - 1) + "1") * (64 // width), 2))
    return sum((F.shiftrightunsigned(fp, j).bitwiseAND(mask) for j in range(1, width)), fp.bitwiseAND(mask))


def _cells(grid: DataFrame, keys: list[str], bits: int, width: int) -> DataFrame:
    """``keys``, fp, and the cells within distance 1: (step: 0, or +-(segment + 1), cell)."""
    grid = grid.select(*keys, "fp", _ones(F.col("fp"), width).alias("c"))
    steps = F.array(*[F.struct(
        F.lit(d * (k + 1)).alias("step"), F.lit(d << (width * k)).cast("long").alias("add"),
        F.expr(f"cast(shiftrightunsigned(c, {width * k}) & {(1 << width) - 1} as int)").alias("n"))
        for k in range(bits // width) for d in (1, -1)])
    home = F.struct(F.lit(0).alias("step"), F.lit(0).cast("long").alias("add"), F.lit(0).alias("n"))
    near = F.concat(F.array(home), F.filter(steps, lambda x: F.when(x["step"] > 0, x["n"] < width).otherwise(x["n"] > 0)))
    return grid.select(*keys, "fp", "c", F.explode(near).alias("x")).select(
        *keys, "fp", F.col("x.step").alias("step"), (F.col("c") + F.col("x.add")).alias("cell"))


def _values(cells: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys`` and the values z of a cell that are within one bit of the fingerprint."""
    bits = F.array(*[F.expr(f"shiftleft(1L, (abs(step) - 1) * {width} + {j})") for j in range(width)])
    fp = F.col("fp")
    flip = F.filter(bits, lambda m: F.when(F.col("step") > 0, fp.bitwiseAND(m) == 0).otherwise(fp.bitwiseAND(m) != 0))
    near = F.when(F.col("step") == 0, F.array("fp")).otherwise(F.transform(flip, lambda m: fp.bitwiseXOR(m)))
    return cells.select(*keys, F.explode(near).alias("z"))


def links(fps: DataFrame) -> DataFrame:
    """Exact links (u, v) between distinct fingerprints ``fp`` at Hamming distance <= 2: for
    every meeting value, each fingerprint with the smallest one there (so connectivity, not
    all pairs)."""
    cells = _cells(fps, [], 64, WIDTH)
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    met = _values(cells.join(crowded, "cell", "left_semi"), ["fp"], WIDTH) \
        .groupBy("z").agg(F.sort_array(F.collect_set("fp")).alias("l")).filter(F.size("l") > 1)
    return met.select(F.col("l")[0].alias("v"), F.explode(F.slice("l", 2, 64)).alias("u")).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id from (doc_id, fp): components of the links, named by the
    smallest doc_id. Documents with one fingerprint are one node, however many they are."""
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(each.select("fp")))
    roots = each.join(comp, each["fp"] == comp["node"]).select("fp", "root", "least")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.select("fp", "root").join(named, "root").select("fp", "component_id")
    named_fp = each.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp, component_id. The fingerprints are written once (checkpoint), since the
    link search and the final join both read them."""
    ready(docs.sparkSession)
    return groups(fingerprints(docs, k).checkpoint())


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- one document of every group -----------------------------------------------------

def keep_one(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row of ``docs`` from every component of the links of :func:`near_duplicates`, with its
    own columns: the row with the smallest doc_id (null after all others), of rows that share it
    the first. Rows are told apart by numbers that are written with them, so repeated rows and
    rows with a null doc_id are removed like any other copy, and a text stays if another row
    under its doc_id goes. Texts without a word are one group. An empty table stays empty;
    columns may have any name."""
    ready(docs.sparkSession)

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint((t or "").encode(), k) for t in texts], np.uint64).view(np.int64))

    marked = written(numbered(docs).withColumn("fp", printed("doc.text")), "near-dedup")
    first = F.min(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "row")).alias("first")
    each = marked.groupBy("fp").agg(first).checkpoint()
    comp = components(links(each.select("fp")))
    stay = each.join(comp, each["fp"] == comp["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")) \
        .agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return marked.join(stay, "row", "left_semi").select("doc.*")
