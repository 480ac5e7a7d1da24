"""URL filters: declared rules first, then naive Bayes over segmented host and path words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.llm.common import ascii_lower, stored

# Rules as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Words that mark a host as an example of what is unwanted.
SEEDS = (
    "adult porn porno sex xxx escort nude casino poker bet bets betting gamble gambling slots lottery jackpot "
    "pills pharma viagra spam ads adserver track tracker tracking clickbait warez crack torrent malware phishing scam"
).split()
SEED_COUNT = 50  # how often the dictionary counts a seed as seen
LEAST_INNER_SEED = 4  # letters a seed needs to count inside a longer name
STRETCH = 64  # letters of a name that are segmented together
LONGEST = 24  # letters of a word
SMOOTHING = 0.01
LETTERS = r"[a-z\u0080-￿]+"


def parsed(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, path)``; both empty for a null url and one without ``://``."""
    rest = F.expr("substring(url, nullif(locate('://', url), 0) + 3)")
    raw = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return pages.select(
        "page_id", "url", F.coalesce(ascii_lower(raw), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    )


def by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as ``struct<length, rule, verdict>``; null where none does."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.greatest(*fits, F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))


def _names(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def dictionary(pages: DataFrame) -> DataFrame:
    """``(word, n)``: words in the titles of all pages, and the seeds."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1)
    seen = pages.select(F.explode(_names(title)).alias("word")).where(F.length("word") <= LONGEST)
    counted = seen.groupBy("word").agg(F.count("*").alias("n"))
    seeds = pages.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, SEEDS))).alias("word"), F.lit(SEED_COUNT).cast("long").alias("n")
    )
    return counted.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most likely split of ``name``; a word that is not known costs ten times more per letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        best.append(
            max(
                (
                    best[start][0]
                    + known.get((start, end - start), math.log(10.0 / total) - (end - start) * math.log(10.0)),
                    start,
                )
                for start in range(max(0, end - LONGEST), end)
            )
        )
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """``(name, parts)`` for distinct names: their words by the dictionary ``words``.

    All substrings up to LONGEST letters meet the dictionary in a join, so it is never sent whole; what
    is gathered for the search is one stretch of STRETCH letters.
    """
    total = words.agg(F.sum("n")).first()[0]
    cuts = F.sequence(F.lit(0), F.expr(f"(length(name) - 1) div {STRETCH}"))
    pieces = names.select("name", F.posexplode(cuts).alias("k", "at")).select(
        "name", "k", F.substring("name", F.col("at") * STRETCH + 1, F.lit(STRETCH)).alias("piece")
    )
    starts = pieces.select("name", "k", "piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("s"))
    spans = starts.select(
        "name", "k", "piece", "s",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("piece") - F.col("s") + 1))).alias("len"),
    ).withColumn("word", F.substring("piece", F.col("s"), F.col("len")))
    found = spans.join(words, "word").groupBy("name", "k", "piece").agg(
        F.collect_list(F.struct((F.col("s") - 1).alias("s"), "len", "n")).alias("known")
    )

    @F.pandas_udf("array<string>")
    def split(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pieces_, known in parts:
            yield pd.Series([
                viterbi(p, {} if k is None else {(x["s"], x["len"]): math.log(x["n"] / total) for x in k}, total)
                for p, k in zip(pieces_, known, strict=True)
            ], dtype=object)

    every = pieces.join(found, ["name", "k", "piece"], "left").withColumn("words", split("piece", "known"))
    return every.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("k", "words"))).alias("w")).select(
        "name", F.flatten(F.transform("w", lambda x: x["words"])).alias("parts")
    )


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, one row per page.

    The rule decides where one fits; else the sign of ``score``, the log odds of naive Bayes. Its examples are the
    distinct hosts, unwanted ones having a seed word; its words are segmented names of host and path.
    Null urls have no words and get the prior; repeated rows get the same verdict; an empty table gives no rows.
    """
    rows = parsed(pages)
    keyed = rows.select("page_id", "host", "path", F.array_join(F.array_distinct(_names(F.col("path"))), " ").alias("path_words"))
    pairs = stored(keyed.select("host", "path_words").distinct(), "url-pairs")
    hosts = pairs.select("host").distinct()
    names = (
        hosts.select(F.explode(_names(F.col("host"))).alias("name"))
        .unionByName(pairs.select("path_words").distinct().select(F.explode(F.split("path_words", " ")).alias("name")))
        .where("name <> ''").distinct()
    )
    parts = stored(segmented(names, stored(dictionary(pages), "url-words")), "url-names")
    # Words of hosts and of the paths, each once per host or path.
    host_words = stored(
        hosts.select("host", F.explode(F.array_distinct(_names(F.col("host")))).alias("name"))
        .join(parts, "name").select("host", "name", F.explode("parts").alias("word")).distinct(),
        "url-host-words",
    )
    seeds = [w for w in SEEDS if len(w) >= LEAST_INNER_SEED]
    marked = F.col("name").isin(*SEEDS) | F.col("word").isin(*seeds)
    unwanted = host_words.groupBy("host").agg(F.max(marked).alias("bad"))
    labelled = hosts.join(unwanted, "host", "left").select("host", F.coalesce("bad", F.lit(False)).alias("bad"))
    path_names = pairs.select("path_words").distinct().select(
        "path_words", F.explode(F.split("path_words", " ")).alias("name")
    )
    path_words = stored(
        path_names.join(parts, "name").select("path_words", F.explode("parts").alias("word")).distinct(), "url-path-words"
    )
    seen = (
        host_words.select("host", F.lit("host").alias("field"), "word").distinct()
        .unionByName(
            pairs.join(path_words, "path_words").select("host", F.lit("path").alias("field"), "word").distinct()
        )
        .join(labelled, "host")
    )
    counts = seen.groupBy("field", "word").agg(
        F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("a")
    )
    model = stored(counts, "url-counts")
    sums = model.groupBy("field").agg(
        F.sum("a").alias("all_a"), F.sum("b").alias("all_b"), F.count("*").alias("v")
    )
    ratio = F.log((F.col("b") + SMOOTHING) / (F.col("all_b") + SMOOTHING * F.col("v"))) - F.log(
        (F.col("a") + SMOOTHING) / (F.col("all_a") + SMOOTHING * F.col("v"))
    )
    weights = stored(model.join(sums, "field").select("field", "word", ratio.alias("weight")), "url-model")
    n_bad, n_all = labelled.agg(F.count_if("bad"), F.count("*")).first()
    prior = math.log((n_bad + SMOOTHING) / (n_all - n_bad + SMOOTHING)) if n_all else 0.0

    def scored(words: DataFrame, key: str, field: str) -> DataFrame:
        own = weights.where(F.col("field") == field).select("word", "weight")
        return words.select(key, "word").distinct().join(own, "word").groupBy(key).agg(
            F.sum("weight").alias(f"of_{field}")
        )

    scores = (
        pairs.join(scored(host_words, "host", "host"), "host", "left")
        .join(scored(path_words, "path_words", "path"), "path_words", "left")
        .select(
            "host", "path_words",
            (F.lit(prior) + F.coalesce("of_host", F.lit(0.0)) + F.coalesce("of_path", F.lit(0.0))).alias("score"),
        )
    )
    # A host may own a third of the rows: adaptive skew joins split it.
    rule = by_rules(F.col("host"), F.col("path"), rules)
    return keyed.join(scores, ["host", "path_words"]).withColumn("fit", rule).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score",
    )
