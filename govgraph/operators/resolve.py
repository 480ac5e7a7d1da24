"""Business terms to concepts by lexical similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govgraph.functions.text import casefold
from govgraph.operators.triples import (
    ALT_LABEL,
    DEFINITION,
    PREF_LABEL,
    RDF_TYPE,
    RDFS_COMMENT,
    RDFS_LABEL,
    local_name,
)
from govgraph.session import is_small, salted_join, stored

# Fixed values of the score: floor of a contained text, weight of a loose match,
# smallest score that counts, and the label predicates in order of preference.
CONTAINED_FLOOR = 0.84
LOOSE_WEIGHT = 0.78
MIN_SCORE = 0.25
LABEL_PREDICATES = (PREF_LABEL, ALT_LABEL, RDFS_LABEL)

# Loose matches are searched down to this score first; only terms without enough of them go on.
SECOND_LEVEL = 0.5
# Terms and labels that meet in one task.
LEFT_BLOCK, RIGHT_BLOCK = 4_096, 2_048
GRAM = 3
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def concept_labels(triples: DataFrame) -> DataFrame:
    """Every label of every concept: ``iri, predicate_rank, matched_on, norm``."""
    rank = F.when(F.col("p") == PREF_LABEL, 0).when(F.col("p") == ALT_LABEL, 1).otherwise(2)
    found = triples.filter(
        F.col("p").isin(*LABEL_PREDICATES)
        & (F.col("o_kind") == "literal")
        & ~F.col("s").startswith("_:")
    )
    return found.select(
        F.col("s").alias("iri"),
        rank.alias("predicate_rank"),
        local_name(F.col("p")).alias("matched_on"),
        casefold(F.col("o")).alias("norm"),
    ).distinct()


def concept_cards(triples: DataFrame) -> DataFrame:
    """Display label, definition and type per concept; the smallest where several exist."""

    def one(predicate: str, kind: str | None = None) -> Column:
        hit = F.col("p") == predicate
        return F.min(F.when(hit if kind is None else hit & (F.col("o_kind") == kind), F.col("o")))

    wanted = [PREF_LABEL, RDFS_LABEL, DEFINITION, RDFS_COMMENT, RDF_TYPE]
    grouped = triples.filter(F.col("p").isin(*wanted)).groupBy(F.col("s").alias("iri")).agg(
        one(PREF_LABEL).alias("_pref"),
        one(RDFS_LABEL).alias("_label"),
        one(DEFINITION).alias("_def"),
        one(RDFS_COMMENT).alias("_comment"),
        one(RDF_TYPE, "iri").alias("concept_type"),
    )
    return grouped.select(
        "iri",
        F.coalesce("_pref", "_label", F.translate(local_name(F.col("iri")), "-_", "  ")).alias("label"),
        F.coalesce("_def", "_comment").alias("definition"),
        "concept_type",
    )


def prepared_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """Distinct terms with the folded, trimmed text that is compared."""
    distinct = terms.select(F.col(column).alias("term")).distinct()
    text = F.trim(casefold(F.col("term")), F.lit(WHITE_SPACE))
    return distinct.filter(F.col("term").isNotNull()).withColumn("query", text)


def _score(query: str, norm: str, ratio: Callable[[], float]) -> float:
    if query == norm:
        return 1.0
    if query in norm or norm in query:
        return max(CONTAINED_FLOOR, ratio())
    return ratio() * LOOSE_WEIGHT


class _Labels:
    """A block of labels with the number of times every letter occurs in each."""

    def __init__(self, frame: pd.DataFrame):
        self.rows = list(frame[_LABEL_COLUMNS].itertuples(index=False, name=None))
        self.texts = frame["norm"].tolist()
        self.lengths = np.array([len(t) for t in self.texts])
        self.column = {c: k for k, c in enumerate(sorted(set().union(*self.texts)))}
        self.matcher: dict[str, SequenceMatcher] = {}

    @cached_property
    def counts(self) -> np.ndarray:
        counts = np.zeros((len(self.texts), len(self.column)), dtype=np.int32)
        for row, text in enumerate(self.texts):
            for letter, n in Counter(text).items():
                counts[row, self.column[letter]] = n
        return counts

    def bound(self, query: str) -> np.ndarray:
        """No loose score of ``query`` is above it: matched letters are at most the letters in common."""
        own = Counter(query)
        known = [c for c in own if c in self.column]
        common = np.minimum(self.counts[:, [self.column[c] for c in known]], [own[c] for c in known]).sum(axis=1)
        return 2.0 * common / (len(query) + self.lengths) * LOOSE_WEIGHT

    def has(self, letter: str, times: int) -> np.ndarray:
        at = self.column.get(letter)
        return np.zeros(len(self.texts), dtype=bool) if at is None else self.counts[:, at] >= times

    def score(self, query: str, row: int) -> float:
        norm = self.texts[row]

        def ratio() -> float:
            # What the matcher knows of its second text serves all terms that meet the label.
            matcher = self.matcher.get(norm)
            if matcher is None:
                matcher = self.matcher[norm] = SequenceMatcher(None, "", norm)
            matcher.set_seq1(query)
            return matcher.ratio()

        return _score(query, norm, ratio)

    def best(self, query: str, rows: np.ndarray, limit: int, least: float) -> list[tuple]:
        """The ``limit`` best concepts among ``rows``; rows come in any order."""
        found: dict[str, tuple] = {}
        for row in rows.tolist():
            raw = self.score(query, row)
            if raw < least:
                continue
            iri, rank, matched_on, norm, label = self.rows[row]
            key = (-round(raw, 4), rank, norm)
            if iri not in found or key < found[iri][0]:
                found[iri] = (key, label, matched_on)
        ranked = sorted((key[0], label, iri, key[1], key[2], m) for iri, (key, label, m) in found.items())
        return [(query, iri, label, -low, rank, norm, m) for low, label, iri, rank, norm, m in ranked[:limit]]


_LABEL_COLUMNS = ["iri", "predicate_rank", "matched_on", "norm", "label"]
_MATCH = "query string, iri string, label string, score double, predicate_rank int, norm string, matched_on string"
_MATCH_COLUMNS = [c.split()[0] for c in _MATCH.split(", ")]


def block_join(left: DataFrame, right: DataFrame, key: str, meet: Callable, schema: str) -> DataFrame:
    """``meet(key, left_block, right_block)`` for all rows that share ``key``, in blocks of bounded size.

    A key's rows are dealt into blocks by hash, as many as its counts need, and every block of one side meets every
    block of the other: one frequent key becomes many tasks, no task holds more than a block of each side, and
    rows are copied once per block of the other side, never once per row of it.
    """
    counted = left.groupBy(key).agg(F.count("*").alias("_n")).join(right.groupBy(key).agg(F.count("*").alias("_m")), key)
    sizes = stored(
        counted.select(
            key,
            F.ceil(F.col("_n") / LEFT_BLOCK).cast("int").alias("_lefts"),
            F.ceil(F.col("_m") / RIGHT_BLOCK).cast("int").alias("_rights"),
        ),
        "block-sizes",
    )

    small = is_small(sizes)

    def dealt(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int").alias(names[0])
        rows = df.join(F.broadcast(sizes), key) if small else salted_join(df, sizes, key)
        return rows.select(*df.columns, block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]))

    keys = [key, "_l", "_r"]
    lefts = dealt(left, "_lefts", "_rights", ("_l", "_r")).groupBy(*keys)
    return lefts.cogroup(dealt(right, "_rights", "_lefts", ("_r", "_l")).groupBy(*keys)).applyInPandas(meet, schema)


def _contained_matches(queries: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Matches in which one text holds the other, the empty one too; the best ``limit`` of every block."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            block = _Labels(right)
            for query in left["query"]:
                hit = np.array([query in norm or norm in query for norm in block.texts])
                rows += block.best(query, np.flatnonzero(hit), limit, CONTAINED_FLOOR)
        return pd.DataFrame(rows, columns=_MATCH_COLUMNS)

    # A text that holds another holds its first letters; nothing stands before the empty text. The mark of a key
    # says which of the two is the longer one.
    def pieces(df: DataFrame, text: str, mark: str) -> DataFrame:
        found = F.array_distinct(F.flatten(F.array(*[_grams(F.col(text), size) for size in range(1, GRAM + 1)])))
        keys = F.transform(F.array_append(found, F.lit("")), lambda gram: F.concat(F.lit(mark), gram))
        return df.withColumn("_gram", F.explode(keys))

    def heads(df: DataFrame, text: str, mark: str) -> DataFrame:
        return df.withColumn("_gram", F.concat(F.lit(mark), F.substring(text, 1, GRAM)))

    left = heads(queries, "query", "<").unionByName(pieces(queries, "query", ">"))
    right = pieces(labels, "norm", "<").unionByName(heads(labels, "norm", ">"))
    return block_join(left, right, "_gram", meet, _MATCH)


def _letters(texts: DataFrame, text: str) -> DataFrame:
    """``(text, letter, occ)``: the n-th occurrence of a letter counts as a token of its own."""
    letters = texts.select(text).distinct().withColumn("letter", F.explode(F.split(text, ""))).filter(F.col("letter") != "")
    counted = letters.groupBy(text, "letter").agg(F.count("*").alias("n"))
    return counted.select(text, "letter", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("occ"))


def _prefixes(tokens: DataFrame, text: str, seen: DataFrame, score: float) -> DataFrame:
    """``(text, token, before)``: the rarest tokens of a text, one of which every match of at least ``score`` shares.

    Texts of a and b letters with ``m`` in common reach ``2 m / (a + b) * LOOSE_WEIGHT`` at most, and m is at most
    b; so ``m >= a * t / (1 - t)`` with ``t = score / (2 * LOOSE_WEIGHT)``. Two texts that share m tokens share one
    that is not among the last m - 1 of the first. ``before`` holds the tokens ahead of this one.
    """
    t = score / (2 * LOOSE_WEIGHT)
    # Rounding must not lose the pair on the edge.
    need = F.ceil(F.length(text) * F.lit(t / (1 - t)) - F.lit(1e-6))
    rare = tokens.join(seen, ["letter", "occ"], "left")
    ordered = rare.groupBy(text).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter", "occ"))).alias("_all")
    )
    kept = F.slice("_all", F.lit(1), F.size("_all") - need.cast("int") + 1)
    each = ordered.select(text, kept.alias("_all")).select(text, "_all", F.posexplode("_all").alias("_at", "_one"))
    token = F.concat(F.col("_one.letter"), F.col("_one.occ").cast("string"))
    before = F.when(F.col("_at") > 0, F.slice("_all", F.lit(1), F.col("_at"))).otherwise(F.slice("_all", 1, 0))
    return each.filter(F.col("_one.n") > 0).select(
        text, token.alias("token"), F.transform(before, lambda b: F.concat(b["letter"], b["occ"].cast("string"))).alias("before")
    )


def _loose_matches(queries: DataFrame, labels: DataFrame, seen: DataFrame, limit: int, score: float) -> DataFrame:
    """Matches of at least ``score`` that hold each other in no way; the best ``limit`` of every block.

    Terms and labels meet at the rarest tokens of both (see ``_prefixes``), and a pair only at the first
    token that it shares, so it is scored once.
    """

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            block = _Labels(right)
            for query, before in zip(left["query"], left["before"], strict=True):
                may = block.bound(query) >= score - 1e-9
                for token in before:
                    may &= ~block.has(token[0], int(token[1:]))
                rows += block.best(query, np.flatnonzero(may), limit, score)
        return pd.DataFrame(rows, columns=_MATCH_COLUMNS)

    left = _prefixes(_letters(queries, "query"), "query", seen, score)
    right = stored(_prefixes(_letters(labels, "norm"), "norm", seen, score).drop("before"), "resolve-prefixes")
    return block_join(left, labels.join(right, "norm"), "token", meet, _MATCH)


def _best(matches: DataFrame) -> DataFrame:
    """One row per term and concept, its best label's."""
    key = F.struct((-F.col("score")).alias("low"), "predicate_rank", "norm", "label", "matched_on")
    best = matches.groupBy("query", "iri").agg(F.min(key).alias("_b"))
    return best.select(
        "query", "iri", "_b.label", (-F.col("_b.low")).alias("score"), "_b.predicate_rank", "_b.norm", "_b.matched_on"
    )


def resolve_terms(
    terms: DataFrame, triples: DataFrame, limit: int = 3, column: str = "term", min_score: float = MIN_SCORE
) -> DataFrame:
    """The best concepts per term: ``term, rank, iri, label, definition, concept_type,
    score, matched_on``.

    A set-similarity join, strongest matches first. Texts that hold each other score at least 0.84 and
    nothing else does, so they are found first, by their first letters. Only terms with fewer than ``limit`` concepts go on to loose
    matches, which share enough letters: down to 0.5, then down to ``min_score``. Every step finds all
    matches of its level, so a term that has ``limit`` concepts is done. Terms and labels are dealt in blocks; neither
    passes through the driver.
    """
    cards = concept_cards(triples)
    labels = stored(concept_labels(triples).join(cards.select("iri", "label"), "iri"), "resolve-labels")
    queries = stored(prepared_terms(terms, column), "resolve-terms")
    open_terms = queries.select("query").distinct()
    found = stored(_best(_contained_matches(open_terms, labels, limit)), "resolve-contained")
    seen = stored(_letters(labels, "norm").groupBy("letter", "occ").agg(F.count("*").alias("n")), "resolve-letters")
    seen = F.broadcast(seen) if is_small(seen) else seen
    for level in (SECOND_LEVEL, min_score):
        if not min_score <= level <= LOOSE_WEIGHT:
            continue
        full = found.filter(F.col("score") >= level).groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
        rest = stored(open_terms.join(full, "query", "left_anti"), "resolve-rest")
        if rest.isEmpty():
            break
        # Scores are rounded: what is left out must not round up to the level.
        least = level if level == min_score else level - 1e-4
        found = stored(_best(found.unionByName(_loose_matches(rest, labels, seen, limit, least))), "resolve-loose")
    order = [F.desc("score"), F.asc("label"), F.asc("iri")]
    ranked = found.filter(F.col("score") >= min_score).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))
    )
    top = ranked.filter(F.col("rank") <= limit).join(cards.drop("label"), "iri", "left")
    return queries.join(top, "query").select(
        "term", "rank", "iri", "label", "definition", "concept_type", "score", "matched_on"
    )


def _grams(text: Column, size: int) -> Column:
    starts = F.when(
        F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - F.lit(size - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(
        F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    )


def _contained(long: DataFrame, long_text: str, short: DataFrame, short_text: str) -> DataFrame:
    """Pairs in which ``short_text`` occurs in ``long_text``, by equi-join.

    The head of the short text (up to three letters) must occur among the pieces
    of the long one; the pairs that share it are then checked exactly.
    """
    length = F.length(short_text)
    heads = short.withColumn("_gram", F.substring(short_text, 1, GRAM)).filter(length >= 1)
    pieces = F.array_distinct(
        F.flatten(F.array(*[_grams(F.col(long_text), size) for size in range(1, GRAM + 1)]))
    )
    grams = long.withColumn("_gram", F.explode(pieces))
    return grams.join(heads, "_gram").filter(F.col(long_text).contains(F.col(short_text))).drop("_gram")


def resolve_lexical(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """Exact and contained matches only, all in the JVM: ``term, iri, score``.

    ``labels`` has ``iri, norm``. The best score per term and concept is given.
    """
    queries = prepared_terms(terms)
    names = labels.select("iri", "norm").distinct()
    inside = _contained(names, "norm", queries, "query")
    around = _contained(queries, "query", names, "norm")
    shorter = F.least(F.length("query"), F.length("norm")).cast("double")
    ratio = 2 * shorter / (F.length("query") + F.length("norm"))
    score = F.when(F.col("query") == F.col("norm"), 1.0).otherwise(
        F.greatest(F.lit(CONTAINED_FLOOR), ratio)
    )
    pairs = inside.unionByName(around).withColumn("score", F.round(score, 4))
    return pairs.groupBy("term", "iri").agg(F.max("score").alias("score"))
