"""Benchmark decontamination with a distributed positional index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govgraph.llm.common import checked_broadcast, stored, word_array

KEY = ["id_key", "text_key"]
MOST_WORDS = 62  # of a window: one bit of a long for each of its words


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key that is never null: an id that repeats with another text is another key."""
    return docs.withColumns({
        "id_key": F.coalesce("doc_id", F.lit(0)),
        "text_key": F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()),
    })


def _keyed(docs: DataFrame) -> DataFrame:
    return keyed(docs.select("doc_id", "text"))


def _tokens(keyed: DataFrame) -> DataFrame:
    return keyed.select(*KEY, F.posexplode(word_array(F.col("text"))).alias("pos", "term"))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``(item_id, phrase, terms)``: every run of ``window`` words; a shorter item is one window."""
    if not 1 <= window <= MOST_WORDS:
        raise ValueError(f"a window has 1 to {MOST_WORDS} words")
    items = benchmark.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    runs = items.select("item_id", "w", F.explode(starts).alias("s"))
    terms = F.slice("w", F.col("s"), window)
    return runs.select("item_id", F.xxhash64(terms).alias("phrase"), terms.alias("terms")).distinct()


def _lists(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(phrase, n, off, term, rank)``: the terms of every phrase, the rarest in the documents first.

    Phrases with a term that no document has are left out: they cannot occur.
    """
    phrases = windows.select("phrase", F.size("terms").alias("n"), "terms").dropDuplicates(["phrase"])
    terms = phrases.select("phrase", "n", F.posexplode("terms").alias("off", "term"))
    wanted = checked_broadcast(stored(terms.select("term").distinct(), "benchmark-terms"))
    counts = (
        _tokens(_keyed(docs)).select("term")
        .join(wanted, "term", "left_semi")
        .groupBy("term").agg(F.count("*").alias("cf"))
    )
    by_phrase = W.partitionBy("phrase")
    ranked = (
        terms.join(counts, "term")
        .withColumn("rank", F.row_number().over(by_phrase.orderBy("cf", "off")))
        .withColumn("found", F.count("*").over(by_phrase))
        .where("found = n")
        .select("phrase", "n", "off", "term", "rank")
    )
    return stored(ranked, "benchmark-lists")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``(id_key, text_key, start, phrase, n)``: exact occurrences of benchmark windows.

    The postings of the two rarest terms of every phrase are shifted by the term's offset and
    intersected; what is left is held against the postings of all terms, read only from
    documents that still have a candidate.
    """
    windows = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    return _exact(docs, _lists(docs, windows))


def _exact(docs: DataFrame, lists: DataFrame) -> DataFrame:
    rare = checked_broadcast(lists.where("rank <= 2"))
    at = [*KEY, "start", "phrase"]
    candidates = stored(
        _tokens(_keyed(docs)).join(rare, "term")
        .where("pos >= off")
        .groupBy(*KEY, (F.col("pos") - F.col("off")).alias("start"), "phrase")
        .agg(F.bit_or(F.col("rank")).alias("ranks"), F.first("n").alias("n"))
        .where(F.col("ranks") == F.when(F.col("n") > 1, 3).otherwise(1))
        .select(*at),
        "benchmark-candidates",
    )
    wanted = candidates.join(checked_broadcast(lists), "phrase").select(
        *at, "n", "off", "term", (F.col("start") + F.col("off")).alias("pos")
    )
    # The texts of these documents alone are read again.
    some = candidates.select(*KEY).distinct()
    tokens = _tokens(_keyed(docs).join(some, KEY, "left_semi"))
    return (
        wanted.join(tokens, [*KEY, "pos", "term"])
        .groupBy(*at).agg(
            F.bit_or(F.expr("shiftleft(1L, off)")).alias("seen"), F.first("n").alias("n")
        )
        .where(F.col("seen") == F.expr("shiftleft(1L, n) - 1"))
        .select(*at, "n")
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, within: int = 20
) -> DataFrame:
    """``(id_key, text_key, phrase, start)``: the two rarest terms of a phrase at most ``within`` words apart.

    Positions are dealt to cells of ``within`` words and every posting meets its own and the
    neighbouring cells only, so no document's lists are multiplied out.
    """
    lists = _lists(docs, benchmark_windows(benchmark, window))
    posted = _tokens(_keyed(docs)).join(checked_broadcast(lists.where("rank <= 2")), "term")
    first = posted.where("rank = 1").select(
        *KEY, "phrase", "pos", F.expr("pos div {0}".format(within)).alias("cell")
    )
    second = posted.where("rank = 2").select(
        *KEY, "phrase", F.col("pos").alias("other"),
        F.explode(F.expr("sequence(pos div {0} - 1, pos div {0} + 1)".format(within))).alias("cell"),
    )
    return (
        first.join(second, [*KEY, "phrase", "cell"])
        .where(F.abs(F.col("pos") - F.col("other")) <= within)
        .select(*KEY, "phrase", F.least("pos", "other").alias("start")).distinct()
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: words, words inside benchmark windows, items found.

    Null and empty texts have no words and no hits. Rows repeated with the same id and text
    each get the same answer; a null id is a value of its own. Empty tables give no hits (or no rows).
    Columns other than doc_id, text and item_id, text are not looked at.
    """
    windows = stored(benchmark_windows(benchmark, window), "benchmark-windows")
    found = stored(_exact(docs, _lists(docs, windows)), "benchmark-found")
    hits = (
        found.select(*KEY, F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos"))
        .distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    )
    # At most as long as the benchmark, which is the stated query set.
    items = (
        found.select(*KEY, "phrase").distinct()
        .join(windows.select("phrase", F.col("item_id").cast("string").alias("item")).distinct(), "phrase")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    marks = hits.join(items, KEY).select(
        *KEY, "n_hit", "items"
    )
    base = _keyed(docs).select("doc_id", *KEY, F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(marks, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
