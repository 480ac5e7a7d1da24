"""Vector codes against a plain version that compares every part with every entry."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from govgraph.llm import vector_codes

SCHEMA = "vec_id long, label int, embedding array<float>, vector int, part int, error string"


def plain(rows):
    """The contract, one vector and one entry at a time."""
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    width = max(4, -(-max(len(v) for _, _, v in kept) // 4) * 4)
    d = width // 4
    whole = []
    for i, lab, v in kept:
        x = [max(-(2**30 // d), min(2**30 // d, math.floor(1024 * c))) for c in v] + [0] * (width - len(v))
        whole.append((i, lab, [x[k * d : (k + 1) * d] for k in range(4)], v))
    start = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:256]
    books = [[r[2][k] for r in start] for k in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), n) for n, entry in enumerate(book))

    for _ in range(4):
        for k in range(4):
            groups = {}
            for r in whole:
                groups.setdefault(near(r[2][k], books[k])[1], []).append(r[2][k])
            books[k] = [
                [sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else entry
                for n, entry in enumerate(books[k])
            ]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    done = [(r[0], r[1], [near(r[2][k], books[k]) for k in range(4)]) for r in whole]
    by_label = Counter()
    for _, lab, found in done:
        by_label[lab] += sum(e for e, _ in found)
    return Counter(
        (i, "".join(f"{n:02x}" for _, n in found), sum(e for e, _ in found), by_label[lab], digest) for i, lab, found in done
    )


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return Counter(
        (r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compressed(frame).collect()
    )


def single(x):
    return float(np.float32(x))


def test_equals_the_plain_version(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 2, None]), [single(rng.gauss(0, 0.3)) for _ in range(12)]) for i in range(1, 330)]
    rows += [(1_000 + i, 7, rows[5][2]) for i in range(120)]  # one very common vector
    rows += [(0, 1, [0.0] * 12), (-5, 1, [0.0] * 12), (5, 3, rows[9][2]), (5, 3, rows[9][2]), (5, 4, rows[11][2])]
    rows += [(None, 2, rows[3][2]), (None, None, [1.0] * 12)]
    rows += [(2_000, 1, None), (2_001, 1, [None] * 12), (2_002, 1, [float("nan")] * 12), (2_003, 1, [float("inf")] * 12)]
    rng.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_lengths_and_large_components(spark):
    rows = [(1, 1, [0.5, -0.5, 0.25]), (2, 1, [single(3e38)] * 6), (3, None, []), (4, None, [single(-3e38)] * 5), (5, 1, [0.5] * 6)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, 1, None)], [(1, None, [0.25] * 8)]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_search_sees_all_ties_and_nothing_nearer_is_missed():
    rng = np.random.default_rng(2)
    for _ in range(40):
        book = rng.integers(-4, 5, size=(rng.integers(1, 60), 3))
        parts = rng.integers(-6, 7, size=(200, 3))
        index, best = vector_codes.EqualAverage(book).nearest(parts)
        all_ = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all()


def test_decode_is_near_the_vector(spark):
    rng = random.Random(8)
    frame = spark.createDataFrame([(i, [rng.random() for _ in range(8)], 0) for i in range(50)], "vec_id long, embedding array<double>, label int")
    kept = vector_codes.kept_vectors(frame)
    books = vector_codes.train(kept)
    vectors = {r["vec_id"]: r["vector"] for r in kept.collect()}
    for r in vector_codes.encode(kept, books).collect():
        assert np.abs(books.decode(r["code"]) - vectors[r["vec_id"]]).max() <= math.sqrt(r["error"] + 1) / 1024 + 1e-3
