"""Language ID by cross-parsing: the language whose sample text parses a document in fewest phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.llm.common import checked_broadcast, held_out, stored

# Bounds of the labelled sample, per language: texts, and letters in all of them together.
SAMPLE_TEXTS = 40
SAMPLE_LETTERS = 40_000
# A document is parsed in stretches of so many symbols, all stretches of a batch side by side.
STRETCH = 256
BATCH_SYMBOLS = 2_000_000
BREAK, UNKNOWN = 0, 1  # symbols: anything but letters; a letter no sample has


def labelled_sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, letters: int = SAMPLE_LETTERS) -> dict[str, str]:
    """A text per language from at most ``texts`` labelled rows that are not held out.

    Per language and slot the row with the smallest hash of its id is taken, an aggregate that
    combines before the shuffle. A sampled text counts up to ``letters`` characters.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    mark = F.xxhash64("doc_id")
    ids = stored(
        rows.select("lang", "doc_id", mark.alias("mark"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(texts)).alias("slot"))
        .groupBy("lang", "slot").agg(F.min_by("doc_id", F.struct("mark", "doc_id")).alias("doc_id"))
        .select("lang", "doc_id"),
        "language-sample",
    )
    picked = (
        rows.join(checked_broadcast(ids), ["lang", "doc_id"], "left_semi")
        .select("lang", F.xxhash64("doc_id").alias("mark"), F.substring("text", 1, letters).alias("text"))
        .collect()
    )
    out: dict[str, str] = {}
    for row in sorted(picked, key=lambda r: (r["lang"], r["mark"], r["text"])):
        out[row["lang"]] = (out.get(row["lang"], "") + "\n" + row["text"])[:letters]
    return out


class _Automata:
    """A suffix automaton per language as one table of moves: state, symbol -> state or -1."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        texts = {name: samples[name].lower() for name in self.names}
        alphabet = sorted({c for text in texts.values() for c in text if c.isalpha()})
        self.n = len(alphabet) + 2
        kind = np.zeros(0x110000, dtype=np.uint16)
        kind[[i for i in range(0x110000) if chr(i).isalpha()]] = UNKNOWN
        for i, c in enumerate(alphabet):
            kind[ord(c)] = i + 2
        self.kind = kind
        self.moves = [self._build(self.symbols(texts[name])) for name in self.names]

    def symbols(self, text: str) -> np.ndarray:
        """Lower-cased letters as symbols; any run of other characters is one break."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self.kind[codes]
        keep = out != BREAK
        keep[1:] |= out[:-1] != BREAK
        return out[keep]

    def _build(self, symbols: np.ndarray) -> np.ndarray:
        link, length, moves = [-1], [0], [{}]
        last = 0
        for c in symbols.tolist():
            new = len(link)
            link.append(0)
            length.append(length[last] + 1)
            moves.append({})
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    moves.append(dict(moves[q]))
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        table = np.full((len(moves), self.n), -1, dtype=np.int32)
        for state, ways in enumerate(moves):
            if ways:
                table[state, list(ways)] = list(ways.values())
        return table

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and letters per text."""
        parsed = [self.symbols(t) for t in texts]
        letters = np.array([int((s != BREAK).sum()) for s in parsed])
        sizes = np.array([len(s) for s in parsed])
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        if not len(owner):
            return out, letters
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count = np.minimum(sizes[owner] - nth * STRETCH, STRETCH)
        order = np.argsort(-count, kind="stable")
        owner, nth, count = owner[order], nth[order], count[order]
        flat = np.concatenate([*parsed, np.zeros(STRETCH, dtype=np.uint16)]).astype(np.int32)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * STRETCH
        active = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")
        for k, moves in enumerate(self.moves):
            root = np.maximum(moves[0], 0)
            flat_moves = moves.ravel()
            state = np.zeros(len(owner), dtype=np.int32)
            ended = np.ones(len(owner), dtype=np.int64)
            for t, n in enumerate(active):
                c = flat[begin[:n] + t]
                to = flat_moves[state[:n] * self.n + c]
                dead = to < 0
                ended[:n] += dead
                state[:n] = np.where(dead, root[c], to)
            out[:, k] = np.bincount(owner, weights=ended, minlength=len(texts))
        return out, letters


_MADE: dict[tuple, _Automata] = {}


def _automata(samples: dict[str, str]) -> _Automata:
    key = tuple(sorted(samples.items()))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = _Automata(samples)
    return _MADE[key]


def classify(texts: list[str | None], samples: dict[str, str]) -> list[tuple[str, float, float]]:
    """``(language, score, phrases per letter)`` of every text, on whole texts.

    A null text and one without letters is ``und`` with score 0; so is every text when there is no sample.
    Ties go to the first name. The score is the share of the winner when every phrase
    more makes a language e times less likely.
    """
    out: list[tuple[str, float, float]] = [("und", 0.0, 1.0)] * len(texts)
    if not samples:
        return out
    made = _automata(samples)
    whole = [i for i, t in enumerate(texts) if t]
    at = 0
    while at < len(whole):
        till, size = at, 0
        while till < len(whole) and (till == at or size + len(texts[whole[till]]) <= BATCH_SYMBOLS):
            size += len(texts[whole[till]])
            till += 1
        chosen = whole[at:till]
        phrases, letters = made.phrases([texts[i] for i in chosen])
        best = phrases.argmin(axis=1)
        least = phrases.min(axis=1)
        score = 1.0 / np.exp(np.minimum(0, least[:, None] - phrases)).sum(axis=1)
        for j, i in enumerate(chosen):
            if letters[j]:
                out[i] = (made.names[best[j]], float(score[j]), float(least[j] / letters[j]))
        at = till
    return out


def identify(docs: DataFrame, samples: dict[str, str]) -> Column:
    """A column ``struct<lang_pred, score, phrases>`` over the ``text`` column of ``docs``."""
    known = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by SAMPLE_LETTERS per language

    @F.pandas_udf("lang_pred string, score double, phrases double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = classify([None if t is None else t for t in texts], known.value)
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "phrases"])

    return run(F.col("text"))


def languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per document, trained on the rows not held out.

    Repeated rows get the same answer each; an empty table gives no rows; other columns are not looked at.
    """
    samples = labelled_sample(docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(docs, samples).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
