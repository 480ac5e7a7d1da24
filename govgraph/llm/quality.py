"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.llm.common import _inverse, _powers, checked_broadcast, held_out, mixed, stored

# Words share 2 ** BUCKET_BITS context vectors of SIZE numbers: a table of 4 MB, whatever the corpus.
BUCKET_BITS, SIZE, NONZERO, WINDOW = 15, 32, 4, 2
# Bound of the labelled sample; a seventh of it sets the temperature.
SAMPLE_ROWS = 14_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.02, 1e-4
THRESHOLD = 0.7
BATCH_BYTES = 2_000_000

_KIND = np.full(256, 3, dtype=np.uint8)  # 0 space, 1 letter, 2 digit, 3 symbol
_KIND[[*range(9, 14), 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def tokens(text: str | None) -> np.ndarray:
    """The bucket of every token: a run of letters, digits or one symbol.

    Words in capitals are one token of their own, so that shouting is a context like any other.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    kind = _KIND[data]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) | ((kind[1:] == 3) & (data[1:] != data[:-1]))) + 1
    start = np.concatenate(([0], cut))
    end = np.concatenate((cut, [len(data)]))
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    low = _LOW[data]
    total = np.concatenate(([np.uint64(0)], np.cumsum(low.astype(np.uint64) * _powers(len(data)), dtype=np.uint64)))
    value = mixed((total[end] - total[start]) * _inverse(start) ^ (end - start).astype(np.uint64))
    capital = np.concatenate(([0], np.cumsum(low != data)))
    small = np.concatenate(([0], np.cumsum((data >= 97) & (data < 123))))
    shouted = (end - start > 1) & (capital[end] > capital[start]) & (small[end] == small[start])
    value[shouted] = np.uint64(1)
    return (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Documents with tokens, together about BATCH_BYTES: their indices, all buckets, first token of each."""
    index: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        own = tokens(text)
        if len(own):
            index.append(i)
            parts.append(own)
            size += len(text)
        if size > BATCH_BYTES:
            yield index, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            index, parts, size = [], [], 0
    if index:
        yield index, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of every bucket's random index vector."""
    rng = np.random.Generator(np.random.PCG64(20_240_607))
    place = rng.random((1 << BUCKET_BITS, SIZE)).argsort(axis=1)[:, :NONZERO]
    return place, rng.choice(np.array([-1.0, 1.0]), place.shape)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context vector of every bucket over all documents: the sum of its neighbours' index vectors.

    Tasks sum what they read; rows of touched buckets are summed in Spark as whole numbers, so any
    order of tasks gives the same table, and its fixed number of rows is what the driver gets.
    """
    names = [f"c{i}" for i in range(SIZE)]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, sign = index_vectors()
        n = 1 << BUCKET_BITS
        table = np.zeros(n * SIZE)
        touched = np.zeros(n, dtype=bool)
        for part in parts:
            for _, bucket, first in _batches(list(part["text"])):
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                touched[bucket] = True
                for off in range(1, WINDOW + 1):
                    same = doc[:-off] == doc[off:]
                    a, b = bucket[:-off][same], bucket[off:][same]
                    for centre, other in ((a, b), (b, a)):
                        at = (centre * SIZE)[:, None] + place[other]
                        table += np.bincount(at.ravel(), sign[other].ravel(), minlength=n * SIZE)
        rows = np.flatnonzero(touched)
        values = table.reshape(n, SIZE)[rows].astype(np.int64)
        for i in range(0, len(rows), 8192):
            out = pd.DataFrame(values[i : i + 8192], columns=names)
            out.insert(0, "bucket", rows[i : i + 8192])
            yield out

    schema = "bucket long, " + ", ".join(f"{c} long" for c in names)
    summed = docs.select("text").mapInPandas(count, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    table = np.zeros((1 << BUCKET_BITS, SIZE), dtype=np.float32)
    found = summed.toPandas()
    if len(found):
        values = found[names].to_numpy(dtype=np.float64)
        length = np.sqrt((values**2).sum(axis=1, keepdims=True))
        table[found["bucket"].to_numpy()] = values / np.maximum(length, 1e-9)
    return table


def pooled(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Per document: the mean vector of its tokens and the mean product of neighbours; zeros without tokens."""
    out = np.zeros((len(texts), 2 * SIZE), dtype=np.float32)
    for index, bucket, first in _batches(texts):
        vectors = table[bucket]
        length = np.diff(first)[:, None]
        out[index, :SIZE] = np.add.reduceat(vectors, first[:-1], axis=0) / length
        vectors[:-1] *= vectors[1:]
        vectors[first[1:] - 1] = 0  # the last token of a document has no neighbour after it
        out[index, SIZE:] = np.add.reduceat(vectors, first[:-1], axis=0) / length
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """A tanh layer and a logistic one, by Adam on six sevenths of the rows, and a temperature on the rest."""
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    rest = np.arange(len(y)) % 7 == 6
    if len(y) < 70 or y[rest].min() == y[rest].max():
        rest = np.zeros(len(y), dtype=bool)
    own, target = z[~rest], y[~rest]
    rng = np.random.Generator(np.random.PCG64(7))
    params = [
        rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(own @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - target) / len(target)
        back = np.outer(error, w2) * (1 - h * h)
        grads = [own.T @ back + DECAY * w1, back.sum(axis=0), h.T @ error + DECAY * w2, error.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = {"centre": centre, "scale": scale, "params": params, "temperature": 1.0}
    if rest.any():
        logits = _logits(x[rest], model)
        grid = np.exp(np.linspace(-1.5, 1.5, 61))
        loss = [np.logaddexp(0, np.where(y[rest] > 0, -1, 1) * logits / t).mean() for t in grid]
        model["temperature"] = float(grid[int(np.argmin(loss))])
    return model


def _logits(x: np.ndarray, model: dict) -> np.ndarray:
    w1, b1, w2, b2 = model["params"]
    return np.tanh((x - model["centre"]) / model["scale"] @ w1 + b1) @ w2 + b2


def probabilities(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return 1 / (1 + np.exp(-np.clip(_logits(x, model) / model["temperature"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, sample: int = SAMPLE_ROWS) -> dict:
    """The network from at most ``sample`` labelled documents that are not held out, one per slot of a hash."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    mark = F.xxhash64("doc_id")
    ids = stored(
        rows.groupBy(F.pmod(mark, F.lit(sample)).alias("slot"))
        .agg(F.min_by(F.struct("doc_id", "quality"), F.struct(F.xxhash64("doc_id", F.lit(1)), "doc_id", "quality")).alias("r"))
        .select("r.doc_id", F.col("r.quality").cast("double").alias("quality")),
        "quality-sample",
    )
    known = docs.sparkSession.sparkContext.broadcast(table)

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = pooled(list(part["text"]), known.value)
            yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"], "x": [r.tobytes() for r in x]})

    found = (
        docs.select("doc_id", "text").join(checked_broadcast(ids), "doc_id")
        .mapInPandas(features, "doc_id long, quality double, x binary").toPandas()
        .sort_values(["doc_id", "x"], ignore_index=True)
    )
    order = np.random.Generator(np.random.PCG64(11)).permutation(len(found))
    x = np.array([np.frombuffer(found["x"].iloc[i], dtype=np.float32) for i in order], dtype=np.float64)
    return fit(x.reshape(len(order), 2 * SIZE), found["quality"].to_numpy(dtype=np.float64)[order])


def scored(docs: DataFrame, table: np.ndarray, model: dict) -> Column:
    """A column with P(quality = 1) of the ``text`` column of ``docs``."""
    known = docs.sparkSession.sparkContext.broadcast((table, model))

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(probabilities(pooled(list(part), known.value[0]).astype(np.float64), known.value[1]))

    return run(F.col("text"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per document, over whole texts.

    Word vectors come from all documents, labels only from rows that are not held out. Null and empty
    texts have the zero vector and the score the network gives it; with labels of one class or none, every score is
    their mean (0.5 without any). Repeated rows get the same score; an empty table gives no rows.
    """
    table = context_vectors(docs)
    model = train(docs, labels, table)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs, table, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
