"""Packing tokenised documents into sequences of equal size, planned on the histogram of lengths.

1. *Pieces.* Every document becomes its token ids and an end id, cut into pieces of at most ``size`` tokens. A
   piece row is a few numbers, stored once; it gets a row number there that never changes again.
2. *Plan.* Best fit, longest first, works on counts: "place ``n`` pieces of length ``L`` into the bins with the
   least room that still fits them". Bins with equal room are ranges of sequence numbers, so a step places any
   number of pieces at once. The plan depends on at most ``size`` counts. A range is entered at most log2(size)
   times, since what stays of its room is less than half, so the plan holds a few entries per length however many
   documents there are; it is all that the driver works on.
3. *Slots.* Every piece gets its rank within its length (a rank within a block of 65,536 stored rows, and sums of
   the blocks before), and takes the planned slot by a join on length and rank. No length, however frequent, is
   gathered in one task.

Nulls and repeats: a null text is empty, so its document is the end id alone. A repeated row is a document of its
own and is packed as often as it stands there; null ids are kept. An empty table has no pieces. Extra columns are
not read. Very long texts are encoded a stretch at a time, so a batch needs its text and its ids, not token objects.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from govgraph.llm.common import checked_broadcast, modest_batches, stored

VOCABULARY = "word_bpe_49k.json"
SIZE, END_ID = 4096, 1

# Rows of a block for ranks, and ranks of a block of slots, as powers of two.
ROW_BITS, RANK_BITS = 16, 10
# Characters encoded at a time, and words whose ids a worker remembers.
STRETCH, REMEMBERED = 1 << 20, 1 << 19

# The tokenizer never makes a token across these; other white space is left to the tokenizer itself.
_GAPS = re.compile(r"[ \n\t\r]+")
_OTHER_SPACE = re.compile(r"[^\S \n\t\r]")
# Letters in every version of Unicode that lower-case to one letter, and marks that always start a token after them.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
_MARKS = frozenset(".,;:!?")
# How byte-level vocabularies spell bytes: those without a visible Latin-1 character follow from 256 on.
_HIDDEN = [*range(33), *range(127, 161), 173]
_SPELT = {byte: 256 + n for n, byte in enumerate(_HIDDEN)}


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers; equal to encoding each text whole.

    The tokenizer drops white space and starts a token after it, so a text's ids are those of its words. Ids of
    words are remembered (``REMEMBERED`` at most, then forgotten together). Words of plain letters need no splitting
    or normal form but lower case and go to the merges at once, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.marks = {mark: self._whole(mark) for mark in _MARKS}
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, letters: str) -> bytes:
        low = letters.lower()
        out = self.known.get(low)
        if out is None:
            spelt = low if low.isascii() else low.encode().decode("latin-1").translate(_SPELT)
            packed = self.packed
            out = self.known[low] = b"".join([packed[t.id] for t in self.merges.tokenize(spelt)])
        return out

    def _learn(self, word: str) -> bytes:
        if _LETTERS.fullmatch(word):
            return self._plain(word)
        if word[-1] in _MARKS and _LETTERS.fullmatch(word, 0, len(word) - 1):
            return self._plain(word[:-1]) + self.marks[word[-1]]
        return self._whole(word)

    def _stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > STRETCH:
            gap = _GAPS.search(text, start + STRETCH)
            if gap is None:
                break
            yield text[start : gap.start()]
            start = gap.end()
        yield text[start:]

    def encode(self, text: str) -> bytes:
        known, out = self.known, []
        for stretch in self._stretches(text):
            # Where no other white space occurs, the usual split cuts at the same places and is faster.
            words = [w for w in _GAPS.split(stretch) if w] if _OTHER_SPACE.search(stretch) else stretch.split()
            new = set(words).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(words)
            for word in new:
                known[word] = self._learn(word)
            out.append(b"".join(map(known.__getitem__, words)))
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame,
    vocabulary: str | None = None,
    size: int = SIZE,
    end_id: int = END_ID,
    ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, and its ``ids`` as bytes where asked for.

    ``vocabulary`` is the path of a tokenizer file that every worker can read. A document has at least its end id,
    so at least one piece.
    """
    modest_batches(docs.sparkSession, 256)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    width, end = 4 * size, end_id.to_bytes(4, "little")
    fields = [StructField("doc_id", docs.schema[id_col].dataType), StructField("piece", IntegerType())]
    fields += [StructField(c, LongType()) for c in ("start", "length", "ids_crc32")]
    if ids:
        fields.append(StructField("ids", BinaryType()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        names = [f.name for f in fields]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = encoder.encode(text or "") + end
                for n, k in enumerate(range(0, len(data), width)):
                    part = data[k : k + width]
                    row = (doc_id, n, k // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if ids else row)
            frame = pd.DataFrame(rows, columns=names)
            frame["doc_id"] = pd.Series([r[0] for r in rows], dtype=object)
            yield frame

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(cut, StructType(fields))


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first: ``(length, first_rank, n, each, first_sequence, offset)``.

    Pieces of ``length`` with rank ``first_rank`` to ``first_rank + n - 1`` go ``each`` to a sequence, one sequence
    after the other from ``first_sequence`` on, the first of a sequence at ``offset``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences (first, how many)
    sizes: list[int] = []  # the keys of room, ascending
    out, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(sizes, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens does not fit a sequence of {size}")
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-todo // (size // length))
                put(size, sequences, n)
                sequences += n
                continue
            left = sizes[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], sizes[at]
            each = min(left // length, todo)
            bins = min(n, todo // each)
            out.append((length, rank, bins * each, each, first, size - left))
            put(left - each * length, first, bins)
            put(left, first + bins, n - bins)
            rank, todo = rank + bins * each, todo - bins * each
    return out


def _slots(spark: SparkSession, steps: list[tuple]) -> DataFrame:
    """The plan, each step split at multiples of 1,024 ranks: ``(length, block, first, n, each, sequence, offset)``."""
    names = "length long, first long, n long, each long, sequence long, offset long"
    rows = spark.createDataFrame(pd.DataFrame(steps, columns=[c.split()[0] for c in names.split(", ")]), names)
    last = F.col("first") + F.col("n") - 1
    # Two levels, so that no array grows with the number of pieces beyond its square root.
    for bits, name in ((RANK_BITS + 15, "_coarse"), (RANK_BITS, "block")):
        lo, hi = F.shiftright("first", bits), F.shiftright(last, bits)
        if name == "block":
            lo = F.greatest(lo, F.shiftleft(F.col("_coarse"), 15))
            hi = F.least(hi, F.shiftleft(F.col("_coarse"), 15) + F.lit((1 << 15) - 1))
        rows = rows.withColumn(name, F.explode(F.sequence(lo, hi)))
    return rows.drop("_coarse")


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    size: int = SIZE,
    end_id: int = END_ID,
    ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece, with ``ids`` (bytes) where asked for."""
    spark = docs.sparkSession
    cut = pieces(docs, vocabulary, size, end_id, ids, id_col, text_col)
    # Stored before numbers are used: a task that runs again later reads the numbers, it does not deal new ones.
    rows = stored(cut.withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    blocks = stored(
        rows.groupBy("length", F.shiftright("_row", ROW_BITS).alias("_block")).agg(F.count("*").alias("n")),
        "packing-blocks",
    )
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = stored(_slots(spark, plan(counts, size)), "packing-slots")
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        blocks.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")), "packing-bases"
    )
    within = Window.partitionBy("length", "_block").orderBy("_row")
    ranked = (
        rows.withColumn("_block", F.shiftright("_row", ROW_BITS))
        .withColumn("_within", F.row_number().over(within) - 1)
        .join(checked_broadcast(bases), ["length", "_block"])
        .withColumn("_rank", F.col("_base") + F.col("_within"))
        .withColumn("_slot", F.shiftright("_rank", RANK_BITS))
        .alias("p")
    )
    s = checked_broadcast(slots).alias("s")
    fits = (
        (F.col("p.length") == F.col("s.length")) & (F.col("p._slot") == F.col("s.block"))
        & (F.col("_rank") >= F.col("s.first")) & (F.col("_rank") < F.col("s.first") + F.col("s.n"))
    )
    nth = F.col("_rank") - F.col("s.first")
    sequence = (F.col("s.sequence") + F.floor(nth / F.col("s.each"))).cast("long")
    offset = (F.col("s.offset") + F.pmod(nth, F.col("s.each")) * F.col("p.length")).cast("long")
    kept = ["p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32"]
    return ranked.join(s, fits).select(*kept, sequence.alias("sequence_id"), offset.alias("offset"), *(["p.ids"] if ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids, documents)`` of a packing made with ``ids=True``; at most ``size`` ids a row.

    ``ids`` are the bytes of all pieces in place; ``documents`` lists doc_id, piece and offset of each.
    """
    part = F.struct("offset", "doc_id", "piece", "ids")
    gathered = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(part)).alias("_parts"))
    joined = F.aggregate("_parts", F.lit(b"").cast("binary"), lambda whole, p: F.concat(whole, p["ids"]))
    places = F.transform("_parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset")))
    return gathered.select("sequence_id", "length", joined.alias("ids"), places.alias("documents"))
