"""Compressing vectors to four bytes: one codebook per part, trained in whole numbers, searched by equal averages.

A vector's components become ``floor(1024 * x)`` and are cut into four parts. Training runs a fixed number of
rounds: every task finds the nearest entry of each of its parts and adds up its parts per entry, Spark adds up the
sums of all tasks, and the driver divides (4 x 256 entries, however many vectors). All of it is exact in whole
numbers, so neither the order of rows nor their dealing changes a result.

*Equal-average search.* Entries are sorted by the sum of their components. By the Cauchy-Schwarz inequality the
squared distance is at least (difference of sums) ** 2 / components. From a part's own sum the search expands to
both sides, nearest sum first, and stops where that bound is strictly above the best distance; entries that tie
with the best are still seen, so the lowest index wins. All parts of a batch take a step together.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped. Shorter vectors,
empty ones too, are filled with zeros to the longest one's length, rounded up to a multiple of four. Components
beyond 2 ** 30 over the length of a part, where squares would leave 64 bits, count as that bound. Ids that repeat are
rows of their own, ordered by their components; null ids come last. With fewer than 256 vectors the codebooks are shorter;
an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from govgraph.llm.common import checked_broadcast, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]`` in whole numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all components in order, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for, in the units of the input."""
        chosen = [self.entries[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))]
        return (np.concatenate(chosen) + 0.5) / SCALE


class EqualAverage:
    """The nearest entry of one codebook, lowest index first among equals."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.lexsort((np.arange(len(entries)), sums))
        self.sums = sums[self.order]
        self.entries = entries[self.order]
        self.squares = (self.entries**2).sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index, squared distance)`` of every row of ``parts``."""
        n, width = parts.shape
        m = len(self.sums)
        best = np.full(n, (1 << 62) // width, dtype=np.int64)
        index = np.full(n, m, dtype=np.int64)
        total, square = parts.sum(axis=1), (parts**2).sum(axis=1)
        right = np.searchsorted(self.sums, total)
        left = right - 1
        rows = np.arange(n)
        far = np.int64(1 << 31)
        while len(rows):
            low, high, own = left[rows], right[rows], total[rows]
            below = np.where(low >= 0, own - self.sums[low], far)
            above = np.where(high < m, self.sums[np.minimum(high, m - 1)] - own, far)
            gap = np.minimum(below, above)
            open_ = (gap < far) & (gap * gap <= best[rows] * width)
            if not open_.all():
                rows, low, high, below, above = rows[open_], low[open_], high[open_], below[open_], above[open_]
            down = below <= above
            at = np.where(down, low, high)
            left[rows] -= down
            right[rows] += ~down
            found = square[rows] + self.squares[at] - 2 * np.einsum("ij,ij->i", parts[rows], self.entries[at])
            name = self.order[at]
            better = (found < best[rows]) | ((found == best[rows]) & (name < index[rows]))
            best[rows[better]] = found[better]
            index[rows[better]] = name[better]
        return index, best


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, vector)`` of the rows whose components are all finite; the vector in double precision."""
    chosen = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return chosen.where(F.col("vector").isNotNull() & ~odd)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Whole numbers, rows filled with zeros to ``width``."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(whole.flatten(), dtype=np.float64)
    sizes = np.asarray(whole.value_lengths(), dtype=np.int64)
    filled = np.zeros((len(sizes), width))
    filled[np.arange(width) < sizes[:, None]] = values
    bound = (1 << 30) // (width // PARTS)
    return np.clip(np.floor(filled * SCALE), -bound, bound).astype(np.int64)


def _searches(entries: np.ndarray) -> list[EqualAverage]:
    return [EqualAverage(book) for book in entries]


def _sums(kept: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries after one round."""
    parts, m, d = entries.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(entries)
        totals, counts = np.zeros((parts, m, d), dtype=np.int64), np.zeros((parts, m), dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch.column("vector"), parts * d)
            for p, search in enumerate(searches):
                own = rows[:, p * d : (p + 1) * d]
                index, _ = search.nearest(own)
                np.add.at(totals[p], index, own)
                counts[p] += np.bincount(index, minlength=m)
        part, entry = np.nonzero(counts)
        values = totals[part, entry]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
                pa.ListArray.from_arrays(np.arange(0, len(part) * d + 1, d, dtype=np.int32), values.ravel()),
            ],
            names=["part", "entry", "n", "sums"],
        )

    found = kept.select("vector").mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]
    out = entries.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
        out[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(d)]
    return out


def train(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks that start as the vectors with the smallest ids and move for ``rounds`` rounds over all rows."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    d = max(1, -(-(longest or 0) // PARTS))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = _matrix(first.column("vector"), PARTS * d)
    books = np.ascontiguousarray(start.reshape(len(start), PARTS, d).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        books = _sums(kept, books)
    return Codebooks(books)


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, code, error)``: two hex digits per part, and the squared distance in whole numbers."""
    entries = books.entries
    parts, _, d = entries.shape
    schema = StructType([*kept.select("vec_id", "label").schema.fields, StructField("code", StringType()), StructField("error", LongType())])
    arrow = to_arrow_schema(schema)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(entries)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("vector"), parts * d)
            found = [s.nearest(rows[:, p * d : (p + 1) * d]) for p, s in enumerate(searches)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            columns = [
                batch.column("vec_id"), batch.column("label"),
                pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(best for _, best in found)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return kept.mapInArrow(coded, schema)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every kept row; null labels are one label."""
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    books = train(kept)
    rows = stored(encode(kept, books), "vector-codes")
    sums = stored(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "vector-code-sums")
    joined = rows.join(checked_broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
