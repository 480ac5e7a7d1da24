"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from govgraph.llm.common import stored

WEIGHTS = (5.0, 2.0, 1.0)
GOLDEN = (math.sqrt(5.0) - 1.0) / 2.0
WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words as runs of anything but ASCII white space; null text: 0."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` from one row per document.

    Sources in code point order, null last, take the weights in turn. A target stops at
    ``most`` times its source; the excess goes to the others by weight. In order of size per weight the
    sources that stop come first, so the level of the rest is the best of one running sum;
    the window runs over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    given = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    by_room = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    total = F.sum("source_size").over(every)
    stopped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    level = given.withColumn("level", (total - stopped) / F.sum("weight").over(after))
    # The first source with room for its share sets the level; the ones before it have stopped.
    fits = F.when(F.col("source_size") * most >= F.col("level") * F.col("weight"), F.col("level"))
    held = level.withColumn("at", fits).withColumn("rank", F.row_number().over(by_room)).withColumn(
        "level", F.min(F.struct(F.col("at").isNull(), "rank", "at")).over(every)["at"]
    )
    return held.select(
        "source", "source_size",
        F.least(F.col("source_size") * F.lit(most), F.col("level") * F.col("weight")).alias("target"),
    )


def _blocks(targets: DataFrame, block: int, least: int) -> DataFrame:
    """Number of equal blocks and of slots for every source; at least ``least`` slots where words suffice."""
    length = F.greatest(F.least(F.lit(float(block)), F.col("target") / least), F.lit(1.0))
    return targets.where("source_size > 0 and target > 0").withColumn(
        "blocks", F.ceil(F.col("source_size") / length)
    ).withColumn("quota", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))


def schedule(blocks: DataFrame, slice_slots: int = 8192) -> DataFrame:
    """``(slot, source, rank)``: which source every slot takes from, and how many it took before.

    Slot j falls on the golden-ratio point frac((j + 1) * phi), and the point on the source whose
    stretch of the cumulative slot shares holds it. Ranks come from counts per slice of slots plus
    a rank inside the slice, so a heavy source is no single task. Enough slots are laid out for
    every source to reach its quota (a source's count strays from its share by a few log n).
    """
    order = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    total = F.sum("quota").over(W.partitionBy())
    stretch = blocks.withColumn("till", F.sum("quota").over(order)).select(
        "source", "quota", ((F.col("till") - F.col("quota")) / total).alias("low"),
        (F.col("till") / total).alias("high"),
    )
    n, few = blocks.agg(F.sum("quota"), F.min("quota")).first()
    n, few = int(n or 0), int(few or 1)
    slots = n + math.ceil(n / max(few, 1) * (8 + 2 * math.log(n + 2))) if n else 0
    # One row per source: sources are a declared, short list, and Spark checks its size itself.
    point = F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0))
    dealt = (
        blocks.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("x"))
        .join(stretch, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
        .select("slot", "source", "quota", F.expr(f"slot div {slice_slots}").alias("part"))
    )
    counts = dealt.groupBy("part", "source").agg(F.count("*").alias("c"))
    prior = counts.withColumn(
        "prior", F.sum("c").over(W.partitionBy("source").orderBy("part")) - F.col("c")
    ).select(F.col("part").alias("p"), F.col("source").alias("s"), "prior")
    ranked = dealt.withColumn(
        "inner", F.row_number().over(W.partitionBy("part", "source").orderBy("slot")) - 1
    )
    return (
        ranked.join(prior, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
        .select("slot", "source", "quota", (F.col("prior") + F.col("inner")).alias("rank"))
        .where("rank < quota").drop("quota")
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, most: float = 3.0, block: int = 1024, least: int = 256,
    rows_per_slice: int = 2_000,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row per document.

    Every source's documents, in the order of a hash of their id (ties: size), form one stream of
    words that is cut into equal blocks; slot number r of a source takes block r modulo their
    number, and a document's ``taken`` is the part of it inside the blocks taken, repeats counted.
    No block is taken more than ``most`` times. Where a document starts in the stream comes from sums
    per slice of the hash order plus a running sum inside a slice, so a source with a third
    of all rows is spread. Null texts and empty texts have size 0 and take nothing; a null source is a
    source; repeated rows are rows of their own; an empty table gives no rows; reruns agree.
    """
    sizes = stored(sized(docs), "mix-sizes")
    targets = source_targets(sizes, weights, most)
    blocks = _blocks(targets, block, least)
    taken = schedule(blocks).join(
        blocks.select(F.col("source").alias("b"), "blocks"), F.col("source").eqNullSafe(F.col("b"))
    ).groupBy("source", F.pmod("rank", "blocks").alias("block")).agg(F.count("*").alias("times"))

    slices = max(64, sizes.count() // rows_per_slice)
    mark = F.xxhash64(F.coalesce("doc_id", F.lit(-1)))
    spot = sizes.withColumn("mark", mark).withColumn("part", F.expr(f"shiftrightunsigned(mark, 1) % {slices}"))
    per_slice = spot.groupBy("source", "part").agg(F.sum("size").alias("c"))
    prior = per_slice.withColumn(
        "prior", F.sum("c").over(W.partitionBy("source").orderBy("part")) - F.col("c")
    ).select(F.col("part").alias("p"), F.col("source").alias("s"), "prior")
    inside = W.partitionBy("source", "part").orderBy("mark", "size")
    placed = (
        spot.withColumn("inner", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)))
        .join(prior, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
        .withColumn("from", F.col("prior") + F.coalesce("inner", F.lit(0)))
        .select("doc_id", "source", "size", "from", (F.col("from") + F.col("size")).alias("to"))
    )
    cut = placed.join(
        blocks.select(F.col("source").alias("b"), F.col("source_size").alias("all"), "blocks"),
        F.col("source").eqNullSafe(F.col("b")),
    ).where("size > 0")
    # Block i holds the words from i * all div blocks up to (i + 1) * all div blocks.
    first = F.expr("((from + 1) * blocks - 1) div all")
    last = F.expr("(to * blocks - 1) div all")
    pieces = (
        cut.withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("low", F.expr("greatest(from, (block * all) div blocks)"))
        .withColumn("high", F.expr("least(to, ((block + 1) * all) div blocks)"))
        .select("doc_id", "source", "from", "block", (F.col("high") - F.col("low")).alias("w"))
        .where("w > 0")
    )
    got = pieces.join(
        taken.select(F.col("source").alias("t"), F.col("block").alias("tb"), "times"),
        F.col("source").eqNullSafe(F.col("t")) & (F.col("block") == F.col("tb")),
    )
    sums = got.groupBy(F.col("source").alias("gs"), F.col("from").alias("gf")).agg(
        F.sum(F.col("w") * F.col("times")).alias("taken")
    )
    # A document with words is known by its source and the place where it starts.
    return (
        placed.join(
            sums,
            F.col("source").eqNullSafe(F.col("gs")) & (F.col("from") == F.col("gf")) & (F.col("size") > 0),
            "left",
        )
        .join(
            targets.select(F.col("source").alias("ts"), "source_size", "target"),
            F.col("source").eqNullSafe(F.col("ts")),
        )
        .select(
            "doc_id", "source", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )
