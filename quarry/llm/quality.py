"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one
failure bit per rule. A policy is a versioned mask over those bits, so applying a policy or
comparing policies reads only the ledger, and ablations ("what would be kept without rule
r?") are bitwise aggregates over it.

All of it is built-in expressions: no Python runs on the executors and there is no shuffle.

Defined results: a null text has no words, lines or symbols; an empty table gives an empty
ledger; every input row gives one ledger row, repeated rows included; a null doc_id is kept.
Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD

#: Bits of a gram's packed sort key that hold its position. Longer texts, and texts in which two
#: different grams share the rest of the key, are sorted by the whole hash and the position.
POS_BITS = 26
POS_MASK = (1 << POS_BITS) - 1

#: Rules in bit order: name -> failure condition over the ledger's measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the policy: the rules whose failure rejects a document."""
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", ("few_words", "repeated_words", "symbols", "word_length", "repeated_lines")),
)}
CURRENT = "v1"


def _packed(grams: Column) -> Column:
    """(hash prefix, position) of every gram as one long, ascending: a primitive sort."""
    return F.sort_array(F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(~POS_MASK)).bitwiseOR(i.cast("long"))))


def _repeated_positions(grams: Column, packed: Column) -> Column:
    """Ascending positions of the grams that occur at least twice. In the packed order equal grams
    are neighbours unless a different gram with their hash prefix stands between them, which shows
    as two neighbours of one prefix and two hashes; such texts, and those whose positions do not
    fit, are sorted by (hash, position) instead. Both arguments are columns of their own (not
    expressions), so they are computed once per row."""
    def full(entry: Column) -> Column:
        return F.get(grams, entry.bitwiseAND(F.lit(POS_MASK)).cast("int"))

    def prefix(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(~POS_MASK))

    same = F.filter(packed, lambda x, i: (full(x) == full(F.get(packed, i + 1)))
                    | ((i > 0) & (full(x) == full(F.get(packed, i - 1)))))
    mixed = F.exists(F.transform(packed, lambda x, i: (prefix(x) == prefix(F.get(packed, i + 1)))
                                 & (full(x) != full(F.get(packed, i + 1)))), lambda m: F.coalesce(m, F.lit(False)))
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    whole = F.transform(F.filter(F.transform(F.array(pairs), lambda s: F.filter(s, lambda x, i: (
        x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"]))))[0], lambda x: x.isNotNull()), lambda x: x["i"])
    fits = F.size(grams) <= POS_MASK
    return F.when(fits & ~mixed, F.sort_array(F.transform(same, lambda x: x.bitwiseAND(F.lit(POS_MASK))))) \
        .otherwise(F.sort_array(whole))


def measure(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """doc_id (or the struct ``carry`` of the row's columns) and the measurements, each
    computed once."""
    d = docs.select((F.col("doc_id") if carry is None else carry).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", F.split(F.trim("t", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+").alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    d = d.select("doc_id", F.regexp_count("t", F.lit("[#*$%&|<>]")).alias("syms"), "lines",
                 F.length(F.array_join("w", "")).alias("chars"),
                 F.when(F.get("w", F.lit(0)) == "", 0).otherwise(F.size("w")).alias("n"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    d = d.select("doc_id", "syms", "chars", "lines", "n", F.when(F.col("n") >= 3, F.transform(
        F.slice("wh", 1, F.greatest(F.col("n") - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get("wh", i + 1), F.get("wh", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("g"))
    none = F.array().cast("array<bigint>")
    d = d.select("doc_id", "syms", "chars", "lines", "n", "g", F.when(
        F.size(F.array_distinct("g")) < F.size("g"), _packed(F.col("g"))).otherwise(none).alias("s"))
    d = d.select("doc_id", "syms", "chars", "lines", "n", F.when(
        F.size("s") > 0, _repeated_positions(F.col("g"), F.col("s"))).otherwise(none).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(
        F.lit(3).cast("long"), F.coalesce(x - F.get("p", i - 1), F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    # adds 0, but as a value of the running task: filters on the measurements then stay above
    # this projection, where pushing them below would evaluate everything again per condition
    here = F.least(F.spark_partition_id(), F.lit(0))
    return d.select(
        "doc_id", (F.col("n") + here).cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"), F.col("syms").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """One row per document: measurements and ``fail_bits`` (bit i = rule i failed)."""
    bits = F.lit(0)
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0))
    return measure(docs, carry).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no bit of the policy's mask is set."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version].mask)) == 0)


def ablations(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, documents that only it rejects, and
    documents kept if it were dropped. One aggregate over the distinct bit patterns."""
    p = POLICIES[version]
    seen = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(p.mask)).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in p.rules])
    x = seen.select("b", "n", F.explode(rules).alias("r")).select("b", "n", "r.*")
    without = F.col("b").bitwiseAND(F.bitwise_not("bit"))
    return x.groupBy("rule").agg(
        F.sum(F.when(F.col("b").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when((F.col("b") != 0) & (without == 0), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("kept_without"))


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of the documents that the policy keeps, with their own columns."""
    kept = apply_policy(ledger(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), version).filter("kept")
    return kept.select("doc_id.*")


def op6(docs: DataFrame) -> DataFrame:
    return apply_policy(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0).alias("base_failed"), "kept", "n_lines", "fail_bits")


#: The same rows in DuckDB; the policy's conditions are the ones above.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT row_number() OVER () AS rid, doc_id, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM l)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(3, coalesce(i - p, 3))) AS n
      FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(ln)::BIGINT AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN c USING (rid)),
b AS (SELECT *, """ + " | ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items()) + f""" AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {BASE.mask}) <> 0 AS base_failed, (fail_bits & {POLICIES[CURRENT].mask}) = 0 AS kept,
       n_lines, fail_bits::INTEGER AS fail_bits FROM b
"""
