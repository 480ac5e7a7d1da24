"""Repeated byte strings between documents: sorted suffix runs, front-coded, exchanged and merged.

Every string of WINDOW bytes holds a gram of GRAM bytes whose hash is smallest among its grams (its anchor), so
only suffixes that start at anchors are exchanged, and of these only those whose gram some other document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govgraph.llm.common import _inverse, _powers, mixed, modest_batches

WINDOW, GRAM = 50, 16
BEFORE = WINDOW - GRAM  # bytes before an anchor that its strings can reach
KEY = WINDOW + BEFORE + 2  # a suffix, what stands before it backwards, and how much of both there is
BLOCK_BYTES = 8_000_000  # text behind one range of gram hashes
RUN_BYTES, RUN_DOCUMENTS, RUN_SUFFIXES = 12_000_000, 60_000, 64_000


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The pick (minimum or maximum) of every stretch of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some string of WINDOW bytes; equal ones all count."""
    n = len(data) - GRAM + 1
    if len(data) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64)[:, 0]
    grams = mixed(words[:n] ^ np.uint64(0x243F6A8885A308D3))
    for i in range(8, GRAM, 8):
        grams = mixed(grams ^ words[i : i + n])
    width = BEFORE + 1
    least = _slide(grams, width, np.minimum)
    edge = np.zeros(BEFORE, dtype=np.uint64)
    best = _slide(np.concatenate((edge, least, edge)), width, np.maximum)
    at = np.flatnonzero(grams == best)
    return at, mixed(grams[at] ^ np.uint64(0x452821E638D01377))


def _sent(x: np.ndarray) -> bytes:
    """Numbers for an exchange: byte by byte of their width, so that leading zeros pack well."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _got(raw: bytes, kind) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Where the groups of equal values of a sorted array begin."""
    if not len(ordered):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))


# --- first exchange: which anchors occur in several documents ---


def gram_runs(docs: DataFrame, ranges: int) -> DataFrame:
    """``(range, hashes, places, ids, owners)``: per task and range of hashes a sorted run of its anchors.

    A gram that several documents of the task have is known to repeat: it is sent once without a place, and its
    places go straight to the result (rows without hashes). So a gram that everyone has is one entry a task.
    """

    def flush(ids: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        table = np.array(ids, dtype=np.int64)
        doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        at = np.concatenate([p[0] for p in parts])
        value = np.concatenate([p[1] for p in parts])
        order = np.argsort(value, kind="stable")
        doc, at, value = doc[order], at[order], value[order]
        begin = _groups(value)
        size = np.diff(np.append(begin, len(value)))
        own = table[doc]
        several = np.repeat(np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin), size)
        yield from (
            (int(r), None, _sent(at[s].astype(np.uint32)), _sent(own[s]), None)
            for r, s in enumerate(np.array_split(np.flatnonzero(several), ranges)) if len(s)
        )
        first = np.zeros(len(value), dtype=bool)
        first[begin] = True
        keep = ~several | first
        value, at, doc, several = value[keep], at[keep].astype(np.uint32), doc[keep].astype(np.uint16), several[keep]
        doc[several] = 65_535
        part = ((value >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(ranges + 1))
        packed = _sent(np.diff(table, prepend=0))
        low = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for r in range(ranges):
            s = order[cut[r] : cut[r + 1]]
            if len(s):
                s = s[np.argsort(low[s], kind="stable")]
                steps = np.diff(low[s].astype(np.int64), prepend=0).astype(np.uint32)
                yield r, _sent(steps), _sent(at[s]), packed, _sent(doc[s])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        names = ["range", "hashes", "places", "ids", "owners"]
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = _bytes(text)
                if len(data) >= WINDOW:
                    ids.append(doc)
                    parts.append(anchors(data))
                    size += len(data)
                if size >= RUN_BYTES or len(ids) >= RUN_DOCUMENTS:
                    yield pd.DataFrame(list(flush(ids, parts)), columns=names)
                    ids, parts, size = [], [], 0
        if ids:
            yield pd.DataFrame(list(flush(ids, parts)), columns=names)

    return docs.select("doc_id", "text").mapInPandas(
        run, "range int, hashes binary, places binary, ids binary, owners binary"
    )


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """``(doc_id, at)`` of the anchors of one range whose gram several documents have."""
    out_doc, out_at, low, at, doc = [], [], [], [], []
    for hashes, places, ids, owners in zip(*(rows[c] for c in ("hashes", "places", "ids", "owners")), strict=True):
        if hashes is None:
            out_doc.append(_got(ids, np.int64))
            out_at.append(_got(places, np.uint32))
            continue
        index = _got(owners, np.uint16)
        table = np.append(np.cumsum(_got(ids, np.int64)), 0)
        known = index == 65_535
        low.append(np.cumsum(_got(hashes, np.uint32), dtype=np.int64))
        at.append(np.where(known, np.uint32(0xFFFFFFFF), _got(places, np.uint32)))
        doc.append(table[np.where(known, len(table) - 1, index)])
    if low:
        value, place, own = map(np.concatenate, (low, at, doc))
        order = np.argsort(value, kind="stable")
        value, place, own = value[order], place[order], own[order]
        begin = _groups(value)
        size = np.diff(np.append(begin, len(value)))
        known = place == np.uint32(0xFFFFFFFF)
        several = (np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)) | np.logical_or.reduceat(known, begin)
        keep = np.repeat(several, size) & ~known
        out_doc.append(own[keep])
        out_at.append(place[keep])
    none = np.zeros(0, dtype=np.int64)
    return pd.DataFrame({
        "doc_id": np.concatenate(out_doc) if out_doc else none,
        "at": (np.concatenate(out_at) if out_at else none).astype(np.int64),
    })


# --- second exchange: sorted, front-coded runs of the suffixes at these anchors ---


def keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of KEY bytes per anchor; rows sort as the suffixes, then as what stands before them."""
    padded = np.concatenate((np.zeros(BEFORE, np.uint8), data, np.zeros(WINDOW, np.uint8)))
    out = np.empty((len(at), KEY), dtype=np.uint8)
    out[:, :WINDOW] = padded[(at + BEFORE)[:, None] + np.arange(WINDOW)]
    out[:, WINDOW : WINDOW + BEFORE] = padded[(at + BEFORE - 1)[:, None] - np.arange(BEFORE)]
    out[:, KEY - 2] = np.minimum(at, BEFORE) + 1
    out[:, KEY - 1] = np.minimum(len(data) - at, WINDOW) + 1
    return out


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted rows as the length each shares with the one before, and the rest of every row."""
    shared = np.zeros(len(rows), dtype=np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), KEY)
    return shared, rows[np.arange(KEY) >= shared[:, None]].tobytes()


def decoded(shared: np.ndarray, rest: bytes) -> list[bytes]:
    out: list[bytes] = []
    last, at = b"", 0
    for n in shared.tolist():
        last = last[:n] + rest[at : at + KEY - n]
        at += KEY - n
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Sorted runs of ``(keys, length shared with the key before)`` as one: run, place in it, length shared.

    A loser tree: every loser keeps how much it shares with the key that beat it. Of two keys the one that shares
    more with the last winner comes first; only where both share as much are they compared, and
    only behind that length. A key's length shared with its run's last key is known from front coding.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [0] * len(runs)
    shared = [0] * k  # of every run's head with the last winner of its matches
    over = [r >= len(runs) or not runs[r][0] for r in range(k)]

    def beats(a: int, b: int) -> bool:
        """Whether head a comes before head b; the loser's shared length becomes that with the winner."""
        if over[a] or over[b]:
            return not over[a]
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        known = shared[a]
        x, y = runs[a][0][heads[a]][known:], runs[b][0][heads[b]][known:]
        if x == y:
            shared[max(a, b)] = KEY
            return a < b
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        same = KEY - (differ.bit_length() + 7) // 8
        first = x < y
        shared[b if first else a] = same
        return first

    losers = [0] * k
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        winners = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            won = beats(a, b)
            winners.append(a if won else b)
            losers[node + i // 2] = b if won else a
        level = winners
    top = level[0]
    out_run: list[int] = []
    out_at: list[int] = []
    out_shared: list[int] = []
    while not over[top]:
        out_run.append(top)
        out_at.append(heads[top])
        out_shared.append(shared[top])
        heads[top] += 1
        if heads[top] == len(runs[top][0]):
            over[top] = True
        else:
            shared[top] = runs[top][1][heads[top]]
        node = (top + k) // 2
        while node:
            other = losers[node]
            if not beats(top, other):
                losers[node], top = top, other
            node //= 2
    return out_run, out_at, out_shared


def covered(rows: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last reach before the anchor of the strings that an earlier document of the group has too.

    Reach r is the string that starts r bytes before the anchor. All strings of a group are held against each
    other by 64-bit hashes of their bytes; strings of one anchor overlap, so its bytes are one stretch.
    The first value is -1 where no string is shared.
    """
    text = np.concatenate((rows[:, WINDOW : WINDOW + BEFORE][:, ::-1], rows[:, :WINDOW]), axis=1)
    before, behind = rows[:, KEY - 2].astype(int) - 1, rows[:, KEY - 1].astype(int) - 1
    total = np.zeros((len(rows), text.shape[1] + 1), dtype=np.uint64)
    np.cumsum(text.astype(np.uint64) * _powers(text.shape[1]), axis=1, dtype=np.uint64, out=total[:, 1:])
    salt = mixed(group.astype(np.uint64))
    low = np.full(len(rows), -1)
    high = np.full(len(rows), -1)
    for reach in range(BEFORE + 1):
        s = np.flatnonzero((before >= reach) & (behind >= WINDOW - reach))
        if len(s) < 2:
            continue
        a = BEFORE - reach
        value = mixed((total[s, a + WINDOW] - total[s, a]) * _inverse(np.array([a]))[0]) ^ salt[s]
        order = np.argsort(value, kind="stable")
        begin = _groups(value[order])
        first = np.minimum.reduceat(doc[s][order], begin)
        hit = s[order[np.repeat(first, np.diff(np.append(begin, len(s)))) < doc[s][order]]]
        low[hit] = np.where(low[hit] < 0, reach, low[hit])
        high[hit] = reach
    return low, high


def suffix_runs(docs: DataFrame, ranges: int) -> DataFrame:
    """``(range, shared, rest, ids, texts, places)``: sorted, front-coded runs of suffixes at repeated anchors.

    Of equal keys only those of the task's smallest document go on: what the others of the task
    repeat is known already (rows without keys: documents, starts and ends of repeated stretches).
    """
    names = ["range", "shared", "rest", "ids", "texts", "places"]

    def flush(parts: list[tuple[np.ndarray, int, int, np.ndarray]]) -> Iterator[tuple]:
        press = zstandard.ZstdCompressor(level=3)
        rows = np.concatenate([p[0] for p in parts])
        count = [len(p[3]) for p in parts]
        doc = np.repeat(np.array([p[1] for p in parts], dtype=np.int64), count)
        text = np.repeat(np.array([p[2] for p in parts], dtype=np.int32), count)
        at = np.concatenate([p[3] for p in parts]).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        order = order[np.argsort(rows[order].view(f"S{KEY}")[:, 0], kind="stable")]
        rows, doc, text, at = rows[order], doc[order], text[order], at[order]
        shared, _ = front_coded(rows)
        begin = np.flatnonzero((shared < KEY) | (np.arange(len(rows)) == 0))
        later = doc > np.repeat(doc[begin], np.diff(np.append(begin, len(rows))))
        if later.any():
            before, behind = rows[later, KEY - 2].astype(int) - 1, rows[later, KEY - 1].astype(int) - 1
            low, high = np.maximum(0, WINDOW - behind), before
            some = low <= high
            start, end = (at[later] - high)[some], (at[later] - low + WINDOW)[some]
            own, which = doc[later][some], text[later][some]
            for r, s in enumerate(np.array_split(np.arange(len(own)), ranges)):
                if len(s):
                    yield r, None, _sent(start[s]), _sent(own[s]), _sent(which[s]), _sent(end[s])
        rows, doc, text, at = rows[~later], doc[~later], text[~later], at[~later]
        gram = np.ascontiguousarray(rows[:, :GRAM]).view(np.uint64)
        part = (mixed(mixed(gram[:, 0]) ^ gram[:, 1]) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(ranges + 1))
        for r in range(ranges):
            s = order[cut[r] : cut[r + 1]]
            if len(s):
                shared, rest = front_coded(rows[s])
                yield r, _sent(shared), press.compress(rest), _sent(doc[s]), _sent(text[s]), _sent(at[s])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple[np.ndarray, int, int, np.ndarray]] = []
        size = 0
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, text, packed, at in zip(*(batch[c] for c in ("doc_id", "text_key", "packed", "at")), strict=True):
                data = np.frombuffer(unpack.decompress(packed), dtype=np.uint8)
                at = np.unique(np.asarray(at, dtype=np.int64))
                at = at[at + GRAM <= len(data)]
                for i in range(0, len(at), RUN_SUFFIXES):
                    some = at[i : i + RUN_SUFFIXES]
                    parts.append((keys(data, some), doc, text, some))
                    size += len(some)
                    if size >= RUN_SUFFIXES:
                        yield pd.DataFrame(list(flush(parts)), columns=names)
                        parts, size = [], 0
        if size:
            yield pd.DataFrame(list(flush(parts)), columns=names)

    return docs.mapInPandas(
        run, "range int, shared binary, rest binary, ids binary, texts binary, places binary"
    )


def _stretches(rows: pd.DataFrame) -> pd.DataFrame:
    """``(doc_id, text_key, start, end)`` of one range: bytes that an earlier document has too."""
    out: list[tuple[np.ndarray, ...]] = []
    runs, doc, text, at = [], [], [], []
    number = lambda raw: _got(raw, np.int64)
    unpack = zstandard.ZstdDecompressor()
    for shared, rest, ids, texts, places in zip(*(rows[c] for c in ("shared", "rest", "ids", "texts", "places")), strict=True):
        if shared is None:
            out.append((number(ids), _got(texts, np.int32).astype(np.int64), number(rest), number(places)))
        else:
            length = _got(shared, np.uint8)
            runs.append((decoded(length, unpack.decompress(rest)), length.tolist()))
            doc.append(number(ids))
            text.append(_got(texts, np.int32).astype(np.int64))
            at.append(number(places))
    if runs:
        run, place, shared = map(np.array, merged(runs))
        first = np.cumsum([0, *map(len, doc)])[:-1]
        index = first[run] + place
        every = [key for keys_, _ in runs for key in keys_]
        doc_, text_, at_ = (np.concatenate(x)[index] for x in (doc, text, at))
        group = np.cumsum(shared < GRAM)
        size = np.bincount(group)
        some = np.flatnonzero(size[group] > 1)
        for k in _bounded(group[some]):
            s = some[k]
            keys_ = np.frombuffer(b"".join([every[i] for i in index[s].tolist()]), dtype=np.uint8).reshape(-1, KEY)
            low, high = covered(keys_, doc_[s], group[s])
            hit = low >= 0
            s = s[hit]
            out.append((doc_[s], text_[s], at_[s] - high[hit], at_[s] - low[hit] + WINDOW))
    none = np.zeros(0, dtype=np.int64)
    columns = [np.concatenate([x[i] for x in out]) if out else none for i in range(4)]
    return pd.DataFrame(dict(zip(("doc_id", "text_key", "start", "end"), columns, strict=True)))


def _bounded(group: np.ndarray, most: int = 16_000) -> Iterator[slice]:
    """Slices of whole groups of about ``most`` entries."""
    begin = 0
    cuts = _groups(group)
    while begin < len(group):
        i = np.searchsorted(cuts, begin + most)
        end = int(cuts[i]) if i < len(cuts) else len(group)
        yield slice(begin, end)
        begin = end


def _packed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, packed)``: the bytes of every text, compressed for the exchanges."""

    @F.pandas_udf("binary")
    def pack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=3)
        for part in parts:
            yield pd.Series([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in part], dtype=object)

    return docs.select(
        "doc_id", F.hash(F.coalesce("text", F.lit(""))).cast("long").alias("text_key"), pack(F.col("text")).alias("packed")
    )


def repeated_stretches(docs: DataFrame, packed: DataFrame, ranges: int) -> DataFrame:
    """``(doc_id, text_key, start, end)``: stretches of bytes whose strings start in an earlier document too."""
    known = docs.where("doc_id is not null")
    at = (
        gram_runs(known, ranges).groupBy("range").applyInPandas(_repeated, "doc_id long, at long")
        .groupBy("doc_id").agg(F.collect_list("at").alias("at"))  # places in one document
    )
    return (
        suffix_runs(packed.join(at, "doc_id"), ranges)
        .groupBy("range").applyInPandas(_stretches, "doc_id long, text_key long, start long, end long")
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per document.

    A byte goes when it lies in a string of 50 bytes that also starts in a document with a smaller id. Null is an
    empty text; texts under 50 bytes lose nothing; rows that repeat an id are judged by the other ids
    only and alike; a null id is neither smaller nor larger than any. An empty table gives no rows.
    """
    modest_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, size // BLOCK_BYTES)
    # Both joins deal the packed texts by the same key, so Spark makes this exchange once.
    packed = _packed(docs.where("doc_id is not null"))
    per_document = repeated_stretches(docs, packed, int(ranges)).groupBy("doc_id").agg(
        F.collect_list(F.struct("text_key", "start", "end")).alias("found")  # stretches of one document
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        names = ("doc_id", "text_key", "packed", "keys", "starts", "ends")
        for batch in batches:
            rows = []
            for doc, key, raw, keys_, starts, ends in zip(*(batch[c] for c in names), strict=True):
                data = unpack.decompress(raw)
                own = np.zeros(0, dtype=bool) if keys_ is None else np.asarray(keys_, dtype=np.int64) == key
                if not own.any():
                    rows.append((doc, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edge, np.asarray(starts, dtype=np.int64)[own], 1)
                np.add.at(edge, np.asarray(ends, dtype=np.int64)[own], -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                rows.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield out.astype({"doc_id": "Int64"})

    none = F.lit(None).cast("array<long>")
    joined = packed.join(per_document, "doc_id", "left").select(
        "doc_id", "text_key", "packed", F.col("found.text_key").alias("keys"),
        F.col("found.start").alias("starts"), F.col("found.end").alias("ends"),
    )
    nameless = _packed(docs.where("doc_id is null")).select(
        "doc_id", "text_key", "packed", none.alias("keys"), none.alias("starts"), none.alias("ends")
    )
    return joined.unionByName(nameless).mapInPandas(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
