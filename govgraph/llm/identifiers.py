"""Personal data: fixed forms, and a bootstrap that learns lexical contexts of unseen identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govgraph.llm.common import stored, word_hashes
from govgraph.llm.decontaminate import keyed

# The kinds in their order, and the forms the contract names.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What may be an identifier of a kind without having its full form.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+(?:@|\s?[\[(](?:at|AT)[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(](?:dot|DOT)[\])]\s?)[A-Za-z0-9-]+)*"),
    "card": re.compile(r"[0-9](?:[\x20._-]?[0-9]){13,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
}
LEFT = 200  # characters before a span in which its two context words are looked for

# What a pattern and an instance need to be believed: distinct instances behind a pattern; the part of all
# occurrences of its context that is followed by believed instances; the belief in an instance.
LEAST_SUPPORT = 5
LEAST_CONFIDENCE = 0.5
# Contexts are told apart in the counting scan by a bit table of fixed size before they are matched exactly.
TABLE_BITS = 20


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed forms: leftmost, not overlapping within a kind, failing ones dropped."""
    out: list[tuple[int, int, int]] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        # All of a run of local characters up to the sign matches or none of it does.
        start = at
        while start > done and _LOCAL[min(ord(text[start - 1]), 128)]:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append((start, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_LOCAL = [chr(i).isalnum() or chr(i) in "._%+-" for i in range(128)] + [False]


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans outside the fixed forms that a context may show to be identifiers."""
    if "@" not in text and not _DIGITS.search(text) and not _SPELT.search(text):
        return []
    taken = [(a, b) for a, _, b in base]
    out: list[tuple[int, int, int]] = []
    for kind, form in LOOSE.items():
        if kind == "email" and "@" not in text and not _SPELT.search(text):
            continue
        for m in form.finditer(text):
            if m.start() and text[m.start() - 1].isalnum():
                continue
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((m.start(), KINDS.index(kind), m.end()))
                taken.append((m.start(), m.end()))
    return sorted(out)


_DIGITS = re.compile(r"[0-9][\x20().0-9_-]{5}")
_SPELT = re.compile(r"[\[(](?:at|AT)[\])]")


def context(text: str, start: int) -> int | None:
    """The hash of the two words before a span; None where there are not two."""
    words = word_hashes(text[max(0, start - LEFT) : start])
    return None if len(words) < 2 else int(_pairs(words[-2:])[0].astype(np.int64))


def _pairs(words: np.ndarray) -> np.ndarray:
    return (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (words[1:] >> np.uint64(1)) ^ (words[1:] << np.uint64(63))


def _cells(patterns: np.ndarray) -> np.ndarray:
    return (patterns * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


SPAN = "struct<start:int,kind:int,end:int>"
LOOSE_SPAN = "struct<start:int,kind:int,end:int,seed:boolean,pattern:long,instance:string>"


def scanned(docs: DataFrame) -> DataFrame:
    """``(doc_id, id_key, text_key, base, found)``: fixed forms, and these and loose spans with their contexts."""

    @F.pandas_udf(f"base array<{SPAN}>, found array<{LOOSE_SPAN}>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                text = text or ""
                base = base_spans(text)
                found = [
                    {
                        "start": a, "kind": k, "end": b, "seed": seed, "pattern": context(text, a),
                        "instance": hashlib.sha256(text[a:b].lower().encode("utf-8", "surrogatepass")).hexdigest()[:32],
                    }
                    for seed, spans in ((True, base), (False, loose_spans(text, base)))
                    for a, k, b in spans
                ]
                rows.append(([{"start": a, "kind": k, "end": b} for a, k, b in base], found))
            yield pd.DataFrame(rows, columns=["base", "found"])

    return keyed(docs.select("doc_id", "text")).withColumn("s", scan(F.col("text"))).select("doc_id", "id_key", "text_key", "s.*")


def context_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, total)``: how often a context occurs in all documents, whatever follows it.

    Only cells of a table of 2 ** TABLE_BITS bits reach the driver, however many patterns there are.
    """
    cell = F.udf(lambda p: int(_cells(np.array([p], dtype=np.int64).view(np.uint64))[0]), "long")
    cells = [r[0] for r in patterns.select(cell("pattern").alias("c")).distinct().collect()]
    bits = np.zeros(1 << TABLE_BITS, dtype=bool)
    bits[cells] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.unpackbits(np.frombuffer(wanted.value, dtype=np.uint8)).astype(bool)
        for part in parts:
            hits = []
            for text in part["text"]:
                words = word_hashes(text)
                if len(words) > 1:
                    pairs = _pairs(words)
                    hits.append(pairs[table[_cells(pairs)]])
            values, times = np.unique(np.concatenate(hits or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"pattern": values.view(np.int64), "total": times})

    return (
        docs.select("text").mapInPandas(count, "pattern long, total long")
        .groupBy("pattern").agg(F.sum("total").alias("total"))
        .join(patterns, "pattern", "left_semi")
    )


def discovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(kind, instance)`` of loose spans that the patterns of the seeds show to be identifiers.

    The graph links patterns (kind and the two words before) with instances, weighted by occurrences.
    A pattern is as good as the part of all occurrences of its words that is followed by instances
    believed so far; an instance is believed by the noisy-or of its good patterns. Beliefs only grow, so
    the rounds end when no instance is added.
    """
    seen = found.select(F.explode("found").alias("f")).select("f.*").where("pattern is not null")
    edges = seen.groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    useful = edges.groupBy("kind", "pattern").agg(F.count("*").alias("m"), F.min("seed").alias("all_seeds")).where(
        (F.col("m") >= LEAST_SUPPORT) & ~F.col("all_seeds")
    ).select("kind", "pattern")
    edges = stored(edges.join(useful, ["kind", "pattern"], "left_semi"), "pii-edges")
    totals = stored(context_totals(docs, edges.select("pattern").distinct()), "pii-totals")
    edges = stored(edges.join(totals, "pattern"), "pii-graph")
    believed = edges.where("seed").select("kind", "instance", F.lit(1.0).alias("score")).distinct()
    known = -1
    while True:
        good = (
            edges.join(believed, ["kind", "instance"], "left").groupBy("kind", "pattern", "total").agg(
                F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))).alias("held"),
                F.count_if(F.col("score") >= LEAST_CONFIDENCE).alias("support"),
            )
            .withColumn("confidence", F.least(F.col("held") / F.col("total"), F.lit(0.999)))
            .where((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= LEAST_CONFIDENCE))
        )
        scores = edges.join(good.select("kind", "pattern", "confidence"), ["kind", "pattern"], "left").groupBy(
            "kind", "instance"
        ).agg(
            F.when(F.max("seed"), 1.0)
            .otherwise(1.0 - F.exp(F.sum(F.log1p(-F.coalesce("confidence", F.lit(0.0))))))
            .alias("score"),
            F.max("seed").alias("seed"),
        ).where(F.col("score") >= LEAST_CONFIDENCE)
        believed = stored(scores, "pii-believed")
        now = believed.count()
        if now == known:
            return believed.where("not seed").select("kind", "instance")
        known = now
        believed = believed.select("kind", "instance", "score")


def spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, id_key, text_key, base, spans)``: the spans of every document, fixed forms and all."""
    found = stored(scanned(docs), "pii-found")
    more = (
        found.select("id_key", "text_key", F.explode("found").alias("f")).where("not f.seed")
        .select("id_key", "text_key", "f.*")
        .join(discovered(docs, found), ["kind", "instance"], "left_semi")
        .groupBy("id_key", "text_key")  # spans of one text, so no more than fit in it
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    )
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    return found.drop("found").join(more, ["id_key", "text_key"], "left").select(
        "doc_id", "id_key", "text_key", "base", every.alias("spans")
    )


def _listed(column: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )


def _equal_or_null(k: int):
    return lambda kind: F.when(kind == k, kind)


def identifiers(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per document.

    Whole texts; null is an empty text. Repeated rows get the same answer each; an empty table gives no
    rows; a null id is a value of its own; columns but doc_id and text are not looked at.
    """
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        F.size(F.array_compact(F.transform(kinds, _equal_or_null(k)))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return spans(docs).select(
        "doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans")
    )


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans go together."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for value, own in zip(texts, marks, strict=True):
            if value is None or own is None or not len(own):
                out.append(value)
                continue
            parts, at = [], 0
            for s in own:
                if s["end"] <= at:
                    continue
                if s["start"] >= at:
                    parts.append(value[at : s["start"]] + f"[{KINDS[s['kind']].upper()}]")
                at = s["end"]
            out.append("".join(parts) + value[at:])
        return pd.Series(out, dtype=object)

    return run(text, found)
