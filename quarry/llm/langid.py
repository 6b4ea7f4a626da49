"""Language identification: word-first backoff.

A document's score for a language is the mean, over its words, of the word's log frequency in
that language. A word that no training document has backs off to the longest of its character
n-grams (5 down to 1) that are known: the mean of their log frequencies. Probabilities are the
softmax of those means scaled by a fixed temperature.

Training: per language the first ``max_docs`` labelled documents in the order of a hash of the
id, for the ``MAX_LANGS`` commonest languages (documented bounds of the sample that fits the
classifier). Counting is distributed; words and n-grams seen once in the sample are left to the
shorter n-grams, and words of more than ``MAX_LETTERS`` letters always are. The model is sparse:
the commonest words and as many n-grams of each length, up to ``MAX_WORDS`` of either, and a count
for each language that has them, up to ``MAX_ENTRIES`` counts a length. That bounds what the
driver collects and sends to every task: 6 x 2,000,000 counts of 8 bytes, 6 x 200,000 strings.

Words are runs of letters (Unicode category L), in learning and in prediction alike.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text
when there is no labelled row; repeated rows are all returned; an empty table gives an empty
result; a row with a null doc_id is not held out and is not learned from. Whole texts are read.
Only ``doc_id``, ``text`` and (for learning) ``lang`` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ready

MAX_DOCS, MAX_WORDS, MAX_GRAM, MIN_COUNT, FOLDS = 1000, 200_000, 5, 2, 5
MAX_LANGS, MAX_LETTERS, MAX_ENTRIES = 1000, 64, 2_000_000
TEMPERATURE = 2.0
LETTERS = regex.compile(r"\p{L}+")
#: The same words for Spark.
SPARK_LETTERS = r"\p{L}+"
_CACHE = 200_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, max_docs: int) -> DataFrame:
    """(lang, text) of at most ``max_docs`` labelled documents a language. The hash limits are
    found from (doc_id, lang) alone, one row per language, and are then a filter on the scan."""
    d = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .withColumn("h", F.xxhash64("doc_id"))
    limits = d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    share = F.least(F.lit(1.0), F.lit(max_docs) / F.col("n"))
    # xxhash64 is uniform over the longs: the lowest share of them is a uniform sample
    limits = limits.select(F.col("lang").alias("_lang"), (F.lit(-2.0 ** 63) + share * F.lit(2.0 ** 64)).alias("top"))
    return d.join(F.broadcast(limits), d["lang"] == limits["_lang"]).filter(F.col("h").cast("double") <= F.col("top")).select("lang", "text")


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> dict:
    """The model: languages, and per word and n-gram a row of log frequencies. At most
    ``max_words`` words (the commonest) and as many n-grams of each length are kept."""
    words = sample(docs, max_docs).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(SPARK_LETTERS), F.lit(0))).alias("g")) \
        .groupBy("lang", "g").agg(F.count("*").alias("n")).checkpoint()
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(MAX_GRAM)), lambda k: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("g") - k + 1, F.lit(1))), lambda i: F.substring(F.col("g"), i, k))))
    grams = words.select("lang", "n", F.explode(F.array_distinct(parts)).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
    both = words.select(F.lit(0).alias("k"), "lang", "g", "n").unionByName(
        grams.select(F.length("g").alias("k"), "lang", "g", "n")).filter(F.length("g") <= MAX_LETTERS)
    top = both.groupBy("k", "g").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")) \
        .filter(F.col("all") >= MIN_COUNT).checkpoint()
    levels = [list(_commonest(top.filter(F.col("k") == k), max_words)) for k in range(MAX_GRAM + 1)]
    langs = sorted({x["lang"] for rows in levels for r in rows for x in r["by"]})
    at = {x: i for i, x in enumerate(langs)}
    index: list[dict] = []
    start, lang, gain, level, none = [0], [], [], [], np.zeros((MAX_GRAM + 1, len(langs)))
    for k, rows in enumerate(levels):
        index.append({r["g"]: len(level) + i for i, r in enumerate(rows)})
        total = np.zeros(len(langs))
        for r in rows:
            for x in r["by"]:
                total[at[x["lang"]]] += x["n"]
        base = total + 0.1 * (len(rows) + 1)
        none[k] = np.log(0.1 / base)  # of a word or n-gram that a language does not have
        for r in rows:
            for x in sorted(r["by"], key=lambda x: x["lang"]):
                lang.append(at[x["lang"]])
                gain.append(np.log((x["n"] + 0.1) / 0.1))
            start.append(len(lang))
            level.append(k)
    return {"langs": langs, "index": index, "start": np.array(start, np.int64), "lang": np.array(lang, np.int32),
            "gain": np.array(gain, np.float32), "level": np.array(level, np.int8), "none": none}


def _commonest(rows: DataFrame, most: int) -> Iterator:
    """The ``most`` commonest of the rows (g, all, by), as long as they hold ``MAX_ENTRIES`` counts."""
    held = 0
    for r in rows.orderBy(F.desc("all"), "g").limit(most).toLocalIterator():
        held += len(r["by"])
        if held > MAX_ENTRIES:
            return
        yield r


class Scorer:
    """Scores texts with a model; the n-gram rows of unseen words are kept (a bounded number)."""

    def __init__(self, model: dict):
        self.langs, self.index, self.none, self.level = model["langs"], model["index"], model["none"], model["level"]
        self.start, self.lang, self.gain = model["start"], model["lang"], model["gain"]
        self.known, self.unseen = self.index[0], {}

    def backoff(self, word: str) -> list[int]:
        """Rows of the known n-grams of the greatest length that has any."""
        rows = self.unseen.get(word)
        if rows is None:
            rows = []
            for k in range(min(MAX_GRAM, len(word)), 0, -1):
                get = self.index[k].get
                rows = [i for j in range(len(word) - k + 1) if (i := get(word[j: j + k])) is not None]
                if rows:
                    break
            if len(self.unseen) >= _CACHE:
                self.unseen.clear()
            self.unseen[word] = rows
        return rows

    def _sum(self, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The log frequencies of the rows, times how often each counts, added up per language."""
        first, n = self.start[at], self.start[at + 1] - self.start[at]
        entries = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        gains = np.bincount(self.lang[entries], np.repeat(times, n) * self.gain[entries], minlength=len(self.langs))
        return gains + np.bincount(self.level[at], times, minlength=MAX_GRAM + 1) @ self.none

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = Counter(LETTERS.findall((text or "").lower()))
        if not found or not self.langs:
            return "und", 0.0
        at, times = [], []
        get = self.known.get
        for w, n in found.items():
            i = get(w)
            if i is not None:
                at.append(i)
                times.append(n)
            elif rows := self.backoff(w):
                at += rows
                times += [n / len(rows)] * len(rows)
        total = self._sum(np.array(at, np.int64), np.array(times, np.float64)) if at else np.zeros(len(self.langs))
        x = TEMPERATURE * total / sum(found.values())
        p = np.exp(x - x.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score; no shuffle. The model, bounded by ``max_words``, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for b in batches:
            got = [score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op5(docs: DataFrame) -> DataFrame:
    ready(docs.sparkSession)
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
