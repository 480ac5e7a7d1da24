"""Streams whose state is keyed: first deliveries, leases, heads as a log of segments."""

import datetime as dt
import random

import pytest
from govgraph.operators import executions, patterns
from govgraph.sources import store
from govgraph.streaming import jobs, segments

DELIVERY = "k string, arrival long, items array<struct<a: int, b: string>>, amount decimal(20,6), at timestamp"
OBSERVED = "tenant_id string, source_id string, execution_id string, seq long, observed_at int, sha256 string"


def deliver(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(path)


def test_first_delivery_of_a_key_ever(spark, tmp_path):
    landing, out, offsets = (str(tmp_path / n) for n in ("landing", "out", "offsets"))
    rng = random.Random(1)
    moment = dt.datetime(2026, 1, 2, 3, 4, 5, 123456)
    done = spark.createDataFrame([("k7",), ("k8",), ("k8",)], "k string")
    expected = {}
    for part in range(3):
        rows = [(f"k{rng.randrange(30)}", 1_000 * part + n, [(n, None)], None, moment) for n in range(60)]
        rows += [(None, 1_000 * part, [], None, None)]
        for row in sorted(rows, key=lambda r: r[1]):
            if row[0] not in ("k7", "k8"):
                expected.setdefault(row[0], row[1])
        deliver(spark, rows, DELIVERY, landing)
        jobs.stream_executions(jobs.table_stream(spark, landing, DELIVERY), out, ["k"], "arrival", offsets, done).awaitTermination()
        got = jobs.read_batches(spark, out).collect()
        assert {r["k"]: r["arrival"] for r in got} == expected and len(got) == len(expected)
        assert all(r["at"] in (moment, None) and (r["items"] == [] or r["items"][0]["b"] is None) for r in got)


def test_no_earlier_output_is_read(spark, tmp_path):
    landing, out, offsets = (str(tmp_path / n) for n in ("landing", "out", "offsets"))
    run = lambda: jobs.stream_executions(jobs.table_stream(spark, landing, DELIVERY), out, ["k"], "arrival", offsets).awaitTermination()
    deliver(spark, [("a", 1, None, None, None), ("b", 2, None, None, None)], DELIVERY, landing)
    run()
    first = [p for p in (tmp_path / "out").iterdir()]
    for folder in first:
        folder.rename(tmp_path / f"away-{folder.name}")
    deliver(spark, [("a", 3, None, None, None), ("c", 4, None, None, None)], DELIVERY, landing)
    run()
    assert [(r["k"], r["arrival"]) for r in jobs.read_batches(spark, out).collect()] == [("c", 4)]


def leases(spark, tmp_path, events, **bounds):
    landing, out, offsets = (str(tmp_path / n) for n in ("claims", "leases", "lease-offsets"))
    schema = "execution_id string, seq long, kind string, at timestamp"
    start = dt.datetime(2026, 5, 1)
    for part in events:
        deliver(spark, [(e, s, k, start + dt.timedelta(seconds=t)) for e, s, k, t in part], schema, landing)
        jobs.stream_leases(jobs.table_stream(spark, landing, schema), out, offsets, **bounds).awaitTermination()
    rows = spark.read.parquet(out).collect()
    return sorted(((r["execution_id"], r["seq"], r["kind"], r["claimed"], r["status"], r["attempts"]) for r in rows), key=repr)


def test_a_lease_runs_out_without_an_event(spark, tmp_path):
    events = [
        [("x", 1, "CLAIM", 0), ("y", 1, "CLAIM", 0), ("y", 2, "COMPLETED", 100), ("late", 1, "CLAIM", 5_000)],
        [("x", 2, "CLAIM", 5_100), ("y", 3, "CLAIM", 5_100)],
    ]
    got = leases(spark, tmp_path, events, delay="10 minutes")
    assert got == sorted([
        ("x", 1, "CLAIM", True, "RUNNING", 1), ("x", None, "LEASE_OVER", False, "EXPIRED", 1), ("x", 2, "CLAIM", True, "RUNNING", 2),
        ("y", 1, "CLAIM", True, "RUNNING", 1), ("y", 2, "COMPLETED", False, "COMPLETED", 1), ("y", 3, "CLAIM", False, "COMPLETED", 1),
        ("late", 1, "CLAIM", True, "RUNNING", 1),
    ], key=repr)


def test_state_is_freed_after_its_time(spark, tmp_path):
    events = [
        [("y", 1, "CLAIM", 0), ("y", 2, "FAILED", 50), ("now", 1, "CLAIM", 900)],
        [("now", 2, "COMPLETED", 20_000)],
        [("y", 3, "CLAIM", 20_100)],
    ]
    got = leases(spark, tmp_path, events, delay="10 minutes", keep_seconds=3_600)
    # What is forgotten starts again with its first attempt.
    assert ("y", 3, "CLAIM", True, "RUNNING", 1) in got


def observations(rng, part, n):
    return [(f"t{rng.randrange(2)}", f"s{rng.randrange(9)}", f"e{part}-{k}", 100 * part + k, rng.randrange(40), rng.choice("abc")) for k in range(n)]


def test_heads_in_segments_equal_heads_advanced_whole(spark, tmp_path):
    landing, path, offsets = (str(tmp_path / n) for n in ("observed", "heads", "offsets"))
    rng, expected = random.Random(4), None
    for part in range(6):
        rows = observations(rng, part, 12 if part % 3 else 2)
        batch = spark.createDataFrame(rows, OBSERVED)
        deliver(spark, rows, OBSERVED, landing)
        jobs.stream_heads(jobs.table_stream(spark, landing, OBSERVED), path, offsets).awaitTermination()
        expected = executions.profile_heads(batch) if expected is None else executions.advance_heads(expected, batch)
        expected = spark.createDataFrame(expected.collect(), expected.schema)
    columns = ["tenant_id", "source_id", "execution_id", "sha256", "previous_sha256", "content_changed"]
    got = jobs.latest_heads(spark, path, spark.createDataFrame([], OBSERVED).schema).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.select(*columns).collect()), key=repr)
    # Six batches leave a merged segment and a short tail; what it replaced is gone a batch later.
    found = segments.segments(spark, path)
    assert segments.active(found) == [(0, 3), (4, 4), (5, 5)] == sorted(found)


def test_a_batch_writes_what_it_moves_and_may_be_repeated(spark, tmp_path):
    path, key = str(tmp_path / "log"), ["k"]
    schema = spark.createDataFrame([], "k long, v string").schema
    put = lambda rows, n: segments.write_segment(spark.createDataFrame(rows, schema), path, n, n, key)
    put([(i, "old") for i in range(500)], 0)
    put([(3, "new")], 1)
    put([(3, "new")], 1)
    written = spark.read.parquet(f"{path}/segment={1:012d}-{1:012d}").count()
    assert written == 1
    keys = spark.createDataFrame([(3,), (4,), (999,)], "k long")
    assert sorted(map(tuple, segments.lookup(spark, path, schema, keys, 2).collect())) == [(3, "new"), (4, "old")]
    # A repeated batch does not see its own output.
    assert sorted(map(tuple, segments.lookup(spark, path, schema, keys, 1).collect())) == [(3, "old"), (4, "old")]
    for n in range(2, 8):
        segments.merge(spark, path, schema, key, n)
        segments.merge(spark, path, schema, key, n)
        put([(n, "new")], n)
    whole = segments.newest(spark, path, schema, key, segments.active(segments.segments(spark, path)))
    assert {r["k"] for r in whole.filter("v = 'new'").collect()} == {2, 3, 4, 5, 6, 7} and whole.count() == 500


@pytest.mark.parametrize("found", [[(0, 0), (1, 1), (0, 1), (2, 2)], [(0, 3), (4, 4), (0, 0), (5, 5), (4, 5)]])
def test_active_segments_cover_every_batch_once(found):
    covered = [n for low, high in segments.active(found) for n in range(low, high + 1)]
    assert covered == list(range(max(high for _, high in found) + 1))
    assert all(high < 2 for _, high in segments.active(found, 2))


def test_put_if_absent_has_one_winner(spark, tmp_path):
    path = str(tmp_path / "pointers" / "1")
    (tmp_path / "pointers").mkdir()
    assert store.read_text(spark, path) is None
    assert store.put_if_absent(spark, path, "first") and not store.put_if_absent(spark, path, "second")
    assert store.read_text(spark, path) == "first"
    assert store.folder_names(spark, str(tmp_path / "pointers")) == ["1"] and store.folder_names(spark, str(tmp_path / "none")) == []


def test_long_chain_closes_in_few_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(400)], "s string, o string")
    asked = []
    empty = type(edges).isEmpty
    monkeypatch.setattr(type(edges), "isEmpty", lambda self: asked.append(1) or empty(self))
    assert patterns.path_closure(edges).count() == 400 * 401 // 2
    assert len(asked) <= 11


def test_closure_equals_brute_force(spark):
    rng = random.Random(12)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)}
    reach = set(pairs)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in pairs if b == c}
        if more == reach:
            break
        reach = more
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "s string, o string")
    assert {(int(r["s"]), int(r["o"])) for r in patterns.path_closure(edges).collect()} == reach
    assert patterns.path_closure(edges.filter("1 = 0")).collect() == []


def test_executions_of_one_bucket_keep_their_own_leases(spark, tmp_path):
    """All executions share a bucket and its timer; one completes, one fails, two run out at different times."""
    first = [("a", 1, "CLAIM", 0), ("b", 1, "CLAIM", 100), ("c", 1, "CLAIM", 0), ("d", 1, "CLAIM", 0), ("c", 2, "COMPLETED", 60), ("d", 2, "FAILED", 60)]
    later = [("z", 1, "CLAIM", 7_000)], [("z", 2, "CLAIM", 7_100), ("d", 3, "CLAIM", 7_100)]
    got = leases(spark, tmp_path, [first, *later], delay="10 minutes", buckets=1)
    over = sorted(row for row in got if row[2] == "LEASE_OVER")
    assert over == [("a", None, "LEASE_OVER", False, "EXPIRED", 1), ("b", None, "LEASE_OVER", False, "EXPIRED", 1)]
    assert ("d", 3, "CLAIM", True, "RUNNING", 2) in got and ("c", 2, "COMPLETED", False, "COMPLETED", 1) in got


def test_first_deliveries_in_any_order_need_no_worker(spark, tmp_path):
    from govgraph.streaming.state import first_deliveries

    stream = jobs.table_stream(spark, str(tmp_path), "k string, v long")
    plan = first_deliveries(stream, ["k"])._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan
