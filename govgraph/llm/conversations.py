"""Repairing the structure of conversations by cheapest edits, with precomputed tables for blocks of rows.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. Rows may be kept (0), given the role user or
assistant (1) or deleted (2, required for blank and duplicate rows); empty rows may be inserted (5); a truncated row
that is not deleted costs 5 more. Of the cheapest edits those whose initials are least in ASCII order are taken.

*Four Russians.* A row is one of nine symbols: its initial (s, u, a or other), whole or truncated, or "must go". The
cost of finishing from a position, per state of the pattern, is a vector of four numbers; less its minimum it is one
of a few dozen. For every block of ``BLOCK`` symbols and every such vector the table holds the vector before the block
and what was subtracted, so costs run backward over a conversation a block at a time. To read the edits, a block is
expanded backward from the vector at its end and walked forward, taking at every step the least letter that is
still on a cheapest way: costs to the end are exact, so no tie is settled too early.

*On Spark.* Rows are dealt and sorted by conversation and turn, so that row numbers follow the order and a conversation
of any size lies over many tasks; chunks of ``1 << CHUNK_BITS`` rows become one row each: a byte per row, and the
texts. A conversation's bytes, which its own audit string equals in length, are all that meets in one task. Repaired texts are
written per chunk and hashed chunk after chunk as a stream, never held together.

Defined results: a null role or text counts as one space, in the key of the damage a null id or turn does too. A null
conversation id is a conversation. Null turns come first; rows of one turn are ordered by role and text after damage (by
64 characters of each, then a hash). Repeated rows are rows, and so duplicates. A role's initial counts as it is: upper case or empty is "other". An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from govgraph.llm.common import checked_broadcast, stored

BLOCK, CHUNK_BITS = 4, 6
# White space of the contract, costs and the letters of the edits, in ASCII order.
SPACE = r"[\x20\x09-\x0D]"
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
DELETED, INSERTED, KEPT, RELABELLED = "DIKR"
FAR = 1 << 20

# States of the pattern: nothing yet, after s, after u, after a. Only the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
# Where an initial leads from each state; None where it does not fit.
STEPS = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
    "o": (None, None, None, None),
}
# The role that an edit gives in each state, user or assistant.
NEXT = (USER, USER, ASSISTANT, USER)

# Row symbols: initial and fault. Upper case for edits, since blank and duplicate rows are alike there.
INITIALS, FAULTS = "suao", ("whole", "truncated", "blank", "duplicate")
SYMBOLS = 9


def _edit_symbol(code: int) -> int:
    """0 to 3: whole rows by initial; 4 to 7: truncated ones; 8: rows that must go."""
    initial, fault = code % 4, code // 4
    return initial + 4 * fault if fault < 2 else SYMBOLS - 1


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a row, given those after it."""
    out = [DELETE + cost for cost in after]
    if symbol < SYMBOLS - 1:
        extra = TRUNCATED if symbol >= 4 else 0
        for state in range(4):
            to = STEPS[INITIALS[symbol % 4]][state]
            if to is not None:
                out[state] = min(out[state], extra + after[to])
            out[state] = min(out[state], extra + RELABEL + after[NEXT[state]])
    return _inserted(out)


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs where any number of rows may be inserted first; two inserts lead back, so two passes are enough."""
    out = list(costs)
    for _ in range(2):
        out = [min(cost, INSERT + out[NEXT[state]]) for state, cost in enumerate(out)]
    return tuple(min(cost, FAR) for cost in out)


END = _inserted([0, FAR, FAR, 0])


class Tables:
    """Cost vectors less their minimum, and their transitions over one symbol and over a block of ``BLOCK``."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [END]
        number = {END: 0}
        single = []
        for vector in self.vectors:  # grows while it is walked
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(symbol, vector)
                low = min(costs)
                costs = tuple(c - low for c in costs)
                if costs not in number:
                    number[costs] = len(self.vectors)
                    self.vectors.append(costs)
                row.append((number[costs], low))
            single.append(row)
        self.single = single
        to = np.array([[t for t, _ in row] for row in single])
        added = np.array([[c for _, c in row] for row in single])
        # A block's number has its first symbol as the highest digit; it is applied last symbol first.
        self.to, self.added = to, added
        for _ in range(block - 1):
            longer = to[self.to]  # [vector, tail, first symbol]
            cost = self.added[:, :, None] + added[self.to]
            shape = (len(to), -1)
            self.to = longer.transpose(0, 2, 1).reshape(shape)
            self.added = cost.transpose(0, 2, 1).reshape(shape)
        self.to_list, self.added_list = self.to.tolist(), self.added.tolist()

    def solve(self, codes: bytes) -> tuple[int, str]:
        """``(cost, script)`` of a conversation's rows.

        The script has a letter per edit: K, D; U, A for a new role; u, a for an inserted row.
        """
        symbols = np.array([_edit_symbol(c) for c in range(16)])[np.frombuffer(codes, dtype=np.uint8)]
        head = len(symbols) % self.block
        powers = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        numbers = (symbols[head:].reshape(-1, self.block) @ powers).tolist()
        vector, cost = 0, 0
        ends = []
        for number in reversed(numbers):
            ends.append(vector)
            cost += self.added_list[vector][number]
            vector = self.to_list[vector][number]
        symbols = symbols.tolist()
        script: list[str] = []
        state = START
        blocks = [(0, head, vector)] if head else []
        blocks += [(head + k * self.block, head + (k + 1) * self.block, end) for k, end in enumerate(reversed(ends))]
        first = vector
        for symbol in reversed(symbols[:head]):
            first, low = self.single[first][symbol]
            cost += low
        for start, stop, end in blocks:
            state = self._walk(symbols[start:stop], end, state, script)
        total = cost + self.vectors[first][START]
        self._finish(state, script)
        return total, "".join(script)

    def _walk(self, symbols: list[int], end: int, state: int, script: list[str]) -> int:
        """Expand a block backward from the vector at its end, then take least letters forward."""
        after = [self.vectors[end]]
        for symbol in reversed(symbols):
            after.append(_before(symbol, after[-1]))
        after.reverse()
        for k, symbol in enumerate(symbols):
            while True:
                now, then = after[k], after[k + 1]
                if now[state] == DELETE + then[state]:
                    script.append("D")
                    break
                if now[state] == INSERT + now[NEXT[state]]:
                    state = NEXT[state]
                    script.append("u" if state == USER else "a")
                    continue
                extra = TRUNCATED if symbol >= 4 else 0
                to = STEPS[INITIALS[symbol % 4]][state]
                if to is not None and now[state] == extra + then[to]:
                    state = to
                    script.append("K")
                else:
                    state = NEXT[state]
                    script.append("U" if state == USER else "A")
                break
        return state

    def _finish(self, state: int, script: list[str]) -> None:
        while state in (SYSTEM, USER):
            state = NEXT[state]
            script.append("u" if state == USER else "a")


@lru_cache(maxsize=1)
def _tables() -> Tables:
    return Tables()


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` after the damage that the crc32 of id and turn decides."""
    chosen = rows.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    marked = chosen.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copies"))
    return marked.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Stored in order of conversation and turn, with ``_row`` ascending in that order over all files."""
    marked = rows.select("*", F.xxhash64("role", "text").alias("_mark"), F.monotonically_increasing_id().alias("_tie"))
    # Short keys: the bounds of the ranges are taken from samples of them. The last lets equal rows lie over several tasks.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    order += [F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("_mark"), F.col("_tie")]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns)
    return stored(dealt.withColumn("_row", F.monotonically_increasing_id()), "conversations-ordered")


def _codes(rows: DataFrame) -> DataFrame:
    """Rows with ``_code``: initial and first fault as one byte."""
    said = F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)
    named = rows.withColumn("_said", said)
    again = stored(
        named.groupBy("conv_id", "_said").agg(F.min("_row").alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "conversations-repeated",
    )
    r = checked_broadcast(again.select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_again"), "_first"))
    joined = named.join(r, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_again")), "left")
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    fault = F.when(blank, 2).when(F.col("_row") > F.col("_first"), 3).when(cut, 1).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", "_row", (first + 4 * fault).alias("_code"))


def _chunks(rows: DataFrame) -> DataFrame:
    """One stored row per chunk of a conversation: ``codes`` as hex digits, and its rows in order."""
    gathered = rows.groupBy("conv_id", F.shiftright("_row", CHUNK_BITS).alias("_chunk")).agg(
        F.array_sort(F.collect_list(F.struct("_row", "_code", "role", "text"))).alias("_rows")
    )
    codes = F.lower(F.array_join(F.transform("_rows", lambda r: F.hex(r["_code"])), ""))
    return stored(gathered.withColumn("codes", codes), "conversations-chunks")


SOLVED = StructType([StructField("cost", LongType()), StructField("scripts", ArrayType(StringType()))])


@F.pandas_udf(SOLVED)
def _solved(codes: pd.Series) -> pd.DataFrame:
    """The cost, and the script of every chunk; what is inserted after the last row belongs to the last chunk."""
    tables, out = _tables(), []
    for chunks in codes:
        rows = bytes(int(c, 16) for c in "".join(chunks))
        cost, script = tables.solve(rows)
        parts, at = [], 0
        for chunk in chunks:
            start, left = at, len(chunk)
            while left:
                left -= script[at] not in "ua"
                at += 1
            parts.append(script[start:at])
        parts[-1] += script[at:]
        out.append((cost, parts))
    return pd.DataFrame(out, columns=["cost", "scripts"])


def _repaired(rows: Column, script: Column) -> Column:
    """The lines ``role:text`` of a chunk after its edits."""
    edits = F.regexp_extract_all(script, F.lit("[ua]*[KDUA]|[ua]+$"), F.lit(0))

    def lines(edit: Column, k: Column) -> Column:
        inserted = F.transform(
            F.regexp_extract_all(edit, F.lit("[ua]"), F.lit(0)), lambda c: F.when(c == "u", F.lit("user:")).otherwise(F.lit("assistant:"))
        )
        last, row = F.right(edit, F.lit(1)), F.get(rows, k)
        role = F.when(last == "K", row["role"]).when(last == "U", F.lit("user")).when(last == "A", F.lit("assistant"))
        own = F.when(role.isNotNull(), F.array(F.concat(role, F.lit(":"), row["text"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(inserted, own)

    return F.flatten(F.transform(edits, lines))


def _hashed(lines: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` from ``(conv_id, _chunk, lines)``, read chunk after chunk."""
    schema = StructType([lines.schema["conv_id"], StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([d[k] for d in done], f.type) for k, f in enumerate(arrow)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, any_line = None, None, False
        for batch in batches:
            done = []
            for key, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, any_line = key, hashlib.sha256(), False
                if text is not None:
                    digest.update((b"\n" if any_line else b"") + text.encode())
                    any_line = True
            yield batch_of(done)
        if digest is not None:
            yield batch_of([(now, digest.hexdigest())])

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "_chunk").mapInArrow(stream, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns, cost, audit, scripts, lines)`` per chunk: the repaired ``role:text`` lines of a damaged table.

    ``rows`` has conv_id, turn, role and text. The lines of a conversation are those of its chunks in order.
    """
    return _solve(_chunks(_codes(_ordered(rows))))[1]


def _solve(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    part = F.struct("_chunk", "codes")
    convs = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    solved = stored(
        convs.withColumn("_solved", _solved(F.col("_parts.codes")))
        .select("conv_id", "_parts._chunk", F.array_join("_parts.codes", "").alias("codes"), "_solved.cost", "_solved.scripts"),
        "conversations-solved",
    )
    each = solved.select(F.col("conv_id").alias("_conv"), "_chunk", F.posexplode("scripts").alias("_k", "_script"))
    scripts = each.select("_conv", F.get("_chunk", F.col("_k")).alias("_at"), "_script")
    lines = chunks.join(scripts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_chunk") == F.col("_at"))).select(
        "conv_id", "_chunk", _repaired(F.col("_rows"), F.col("_script")).alias("lines")
    )
    return solved, lines


def audited(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every conversation of ``rows`` after damage: its gaps, faults, cheapest edits and the hash of its repair."""
    all_ids = rows.select(F.col(id_col).alias("conv_id")).distinct()
    ordered = _ordered(damaged(rows, id_col, turn_col, role_col, text_col))
    solved, lines = _solve(_chunks(_codes(ordered)))
    joined = lines.select("conv_id", "_chunk", F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("lines"))
    hashes = _hashed(joined)
    turns = ordered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    codes = F.col("codes")

    def count(digits: str) -> Column:
        return (F.length(codes) - F.length(F.translate(codes, digits, ""))).cast("long")

    initials = F.translate(codes, "0123456789abcdef", INITIALS * len(FAULTS))
    # Adjacent pairs that read su, ua or au: each start that is followed by what may follow.
    legal = F.size(F.regexp_extract_all(initials, F.lit("s(?=u)|u(?=a)|a(?=u)"), F.lit(0)))
    audit = F.translate(F.array_join("scripts", ""), "UAua", "RRII")
    found = solved.select(
        "conv_id", count("89ab").alias("blank"), count("cdef").alias("duplicate"), count("4567").alias("truncated"),
        (F.length(codes) - 1 - legal).cast("long").alias("illegal"), "cost", audit.alias("audit"),
    )
    empty = hashlib.sha256(b"").hexdigest()
    out = all_ids
    for side in (turns, found, hashes):
        right = side.withColumnRenamed("conv_id", "_side")
        out = out.join(right, F.col("conv_id").eqNullSafe(F.col("_side")), "left").drop("_side")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
