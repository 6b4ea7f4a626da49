"""Text and log analysis: marker-offset stat parsing, first-match lookup, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.sequence import DEFAULT_CHUNK_ROWS, neighbours, number_rows, running_totals
from quarry.session import ensure_checkpoint_dir

#: Sides of joins of up to so many rows, counted first, are broadcast.
BROADCAST_ROWS = 100_000


def words(text) -> "F.Column":
    """Whitespace tokens like Python's ``str.split()``: no empty tokens at either end."""
    return F.array_remove(F.split(text, r"\s+"), "")


def _after(text, marker: str, n: int) -> "F.Column":
    """Up to n tokens that follow the first token equal to ``marker``; none without one. The search
    stops there, so the rest of a long text is not cut into tokens."""
    found = F.regexp_extract(text, r"(?:^|\s)\Q" + marker + r"\E(?=\s|$)((?:\s+\S+){0," + str(n) + "})", 1)
    return words(found)


def _at(arr, idx):
    """1-based element, null when out of range."""
    return F.when((idx >= 1) & (idx <= F.size(arr)), F.element_at(arr, idx.cast("int")))


def parse_stats(docs: DataFrame, marker: str, offsets=(1, 3, 8), duration_marker: str | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """After the first ``marker`` token take the tokens at the given offsets ('' when the
    marker is absent or the offset runs past the end); the first also as a number, 0 when it
    does not parse. With ``duration_marker``: cut the text after the first character of its
    first occurrence, then take the token 2 after the next whole-token occurrence, minus
    its last character (null when either occurrence is missing)."""
    d = docs.select(id_col, text_col, _after(F.col(text_col), marker, max(offsets)).alias("_w"))
    names = ("amount", "objects", "throughput")
    cols = [F.coalesce(_at(F.col("_w"), F.lit(off)), F.lit("")).alias(n) for n, off in zip(names, offsets)]
    d = d.select(id_col, text_col, *cols)
    d = d.withColumn("amount_num", F.coalesce(F.expr("try_cast(amount AS DOUBLE)"), F.lit(0.0)))
    if duration_marker:
        d = d.withColumn("_pos", F.instr(F.col(text_col), duration_marker))
        rest = F.expr(f"CASE WHEN _pos > 0 THEN substr({text_col}, _pos + 1) END")
        d = d.withColumn("_tok", _at(_after(rest, duration_marker, 2), F.lit(2)))
        d = d.withColumn("duration", F.expr("substr(_tok, 1, length(_tok) - 1)")).drop("_pos", "_tok")
    return d.drop(text_col)


def sum_stats(docs: DataFrame, marker: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line holding the ``marker`` token counts: per text, the number of such lines and
    the sums of the numbers one and three tokens after the marker (0 where a token is missing
    or not a number)."""
    lines = docs.select(id_col, F.explode(F.split(text_col, "\n")).alias("_line"))
    w = lines.select(id_col, words(F.col("_line")).alias("_w"))
    idx = F.array_position("_w", marker)

    def number(offset):
        return F.coalesce(_at(F.col("_w"), idx + offset).try_cast("double"), F.lit(0.0))

    hit = w.filter(idx > 0).select(id_col, number(1).alias("_a"), number(3).alias("_o"))
    return hit.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("_a").alias("amount"), F.sum("_o").alias("objects"))


def parse_task_line(line) -> "F.Column":
    """Task log line: token 2 is the task name, the first [...] is the priority."""
    w = words(line)
    return F.struct(_at(w, F.lit(2)).alias("task_name"),
                    F.regexp_extract(line, r"(\[[^\]]*\])", 1).alias("priority"))


def _grams(col, q: int):
    """Distinct substrings of q characters of a word (none when it is shorter)."""
    n = F.length(col) - (q - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(col, i, F.lit(q)))))


def _words_holding(pieces: DataFrame, vocabulary: DataFrame, q: int = 3) -> DataFrame:
    """(piece, word): the words that contain a piece, found by the piece's first q characters
    (all of them when it is shorter) and confirmed with ``contains``."""
    sized = pieces.withColumn("_gram", F.substring("piece", 1, q))
    grams = vocabulary.select("word", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(
        *[_grams(F.col("word"), k) for k in range(1, q + 1)]))))).alias("_gram"))
    return sized.join(grams, "_gram").filter(F.col("word").contains(F.col("piece"))).select("piece", "word").distinct()


def _bounded(side: DataFrame, bound: int) -> DataFrame:
    """A materialised side of a join, broadcast if it has at most ``bound`` rows (counted)."""
    return F.broadcast(side) if side.limit(bound + 1).count() <= bound else side


def first_match(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """For each (item_id, token), the smallest doc_id whose text contains the token;
    tokens found nowhere, and tokens without a word, are dropped.

    Exact without comparing every token with every text. Each word inside a token must be
    part of some word of any text containing the token: an interior one (white space on both
    sides) is a whole word there. A token is anchored on its rarest interior word (occurrences
    from one aggregate over the words that tokens ask for), or, with two words or fewer, on the
    words of the texts' vocabulary that hold its longest word. Only texts with an anchor are
    candidates, and ``contains`` confirms them. No word of a text is shuffled unless a token is
    anchored on it (while the anchors are few enough to be broadcast).
    """
    key = ["item_id", "token"]
    ensure_checkpoint_dir(docs.sparkSession)
    tw = tokens.select(*key, words(F.col("token")).alias("_w")).distinct().checkpoint()
    interior = tw.filter(F.size("_w") >= 3).select(
        *key, F.explode(F.array_distinct(F.slice("_w", F.lit(2), F.size("_w") - 2))).alias("word"))
    short = tw.filter(F.size("_w").between(1, 2)).select(*key, F.expr(
        "CASE WHEN size(_w) = 1 OR length(_w[0]) >= length(_w[1]) THEN _w[0] ELSE _w[1] END").alias("piece"))
    text_words = docs.select("doc_id", F.explode(F.split("text", r"\s+")).alias("word"))
    asked = interior.select("word").distinct().checkpoint()
    freq = text_words.join(_bounded(asked, BROADCAST_ROWS), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # a word that no text has leaves its token without a match
    anchor = interior.join(freq, "word", "left").groupBy(*key).agg(
        F.min_by("word", F.struct("df", "word")).alias("word"), F.count_if(F.col("df").isNull()).alias("_absent")) \
        .filter("_absent = 0").select(*key, "word")
    if short.limit(1).count():  # only then is the texts' whole vocabulary looked through
        holding = _words_holding(short.select("piece").distinct(), text_words.select("word").filter("word <> ''").distinct())
        anchor = anchor.unionByName(short.join(holding, "piece").select(*key, "word"))
    anchor = anchor.checkpoint()
    cand = text_words.join(_bounded(anchor, BROADCAST_ROWS), "word").groupBy("doc_id").agg(
        F.collect_set(F.struct(*key)).alias("_t")).checkpoint()  # a text meets its tokens as one list
    hits = docs.select("doc_id", "text").join(_bounded(cand, BROADCAST_ROWS), "doc_id").select(
        "doc_id", F.explode(F.filter("_t", lambda t: F.col("text").contains(t["token"]))).alias("_h"))
    return hits.groupBy("_h.item_id", "_h.token").agg(F.min("doc_id").alias("doc_id"))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str,
                chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Runs of consecutive equal ``value`` inside each key: (start position, length). Rows are
    numbered once; the running number of changes names the run."""
    a = number_rows(df.select(*keys, *order, value), keys, order, rn="_rn")
    b = neighbours(a, keys, "_rn", {"_before": (value, -1)}, chunk_rows)
    change = ((F.col("_rn") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).cast("long")
    return (running_totals(b, keys, "_rn", {"_island": change}, chunk_rows)
            .groupBy(*keys, value, "_island")
            .agg(F.min("_rn").alias("run_start"), F.count(F.lit(1)).alias("run_length"))
            .drop("_island"))
