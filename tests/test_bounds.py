"""What grows past an old bound, and patterns without shared variables."""

import pytest
from pyspark.sql import functions as F

from govgraph.operators import context, inference, patterns, profiling, registry, review, shapes
from govgraph.operators.triples import PREF_LABEL, RDF_TYPE
from govgraph.session import local_frame, small_join, stored
from govgraph.sources import files, sinks


def frame(spark, schema, *rows):
    return local_frame(spark, list(rows), schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_products_are_asked_for_whatever_their_size(spark):
    a, b = frame(spark, "x string", ("1",), ("2",)), frame(spark, "y string", ("3",))
    with pytest.raises(ValueError):
        patterns.bgp(a, b)
    assert rows(patterns.bgp(a, b, product=True)) == [("1", "3"), ("2", "3")]
    many = spark.range(3_000).select(F.col("id").cast("string").alias("y"))
    assert patterns.bgp(a, many, product=True).count() == 6_000


def test_exists_and_values_without_shared_variables(spark):
    a, some, none = frame(spark, "x string", ("1",), ("2",)), frame(spark, "y string", ("3",)), frame(spark, "y string")
    assert rows(patterns.exists(a, some)) == rows(patterns.not_exists(a, none)) == [("1",), ("2",)]
    assert rows(patterns.exists(a, none)) == rows(patterns.not_exists(a, some)) == []
    assert rows(patterns.values(a, ["z"], [("p",), ("q",)])) == [("1", "p"), ("1", "q"), ("2", "p"), ("2", "q")]
    assert rows(patterns.values(a, ["x", "z"], [("1", "p"), (None, "q")]).select("x", "z")) == [("1", "p"), ("1", "q"), ("2", "q")]


def test_unbound_variables_agree_with_anything(spark):
    left = frame(spark, "s string, v string", ("a", "1"), ("b", None))
    right = frame(spark, "v string, w string", ("1", "x"), ("2", "y"))
    joined = patterns.bgp(left, right, unbound=("v",)).select("s", "v", "w")
    assert rows(joined) == [("a", "1", "x"), ("b", "1", "x"), ("b", "2", "y")]
    assert rows(patterns.pattern_minus(left, frame(spark, "v string", ("1",)), unbound=("v",)).select("s")) == [("b",)]


def test_all_column_names_are_kept(spark):
    names = [f"c{i:03}" for i in range(150)] + ["x" * 300]
    text = frame(spark, "t string", (",".join(names) + "\n",))
    assert text.select(profiling.csv_column_names(F.col("t"))).first()[0] == names
    assert len(files.check_header(names * 1 + [f"d{i}" for i in range(200)])) == 351


def test_csv_keeps_records_of_empty_cells_and_checks_every_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text('a,b\n1,2\n,\n   \n\n"x ""y""",3\n')
    got = files.read_csv_source(spark, str(tmp_path / "one.csv"))
    assert got.columns == ["a", "b"]
    assert sorted(got.collect(), key=str) == sorted([("1", "2"), (None, None), ('x "y"', "3")], key=str)
    (tmp_path / "two.csv").write_text("b,a\n5,6\n")
    with pytest.raises(Exception):
        files.read_csv_source(spark, str(tmp_path)).collect()


def test_bundles_keep_older_snapshots(spark, tmp_path):
    def bundle(snapshot, n):
        return {"profile": frame(spark, "tenant_id string, source_id string, snapshot_id string, n int", ("t", "s", snapshot, n))}

    for snapshot, n in (("one", 1), ("two", 2), ("two", 3)):
        sinks.write_profile_bundle(bundle(snapshot, n), str(tmp_path))
    kept = spark.read.parquet(str(tmp_path / "profile")).select("snapshot_id", "n")
    assert rows(kept) == [("one", 1), ("two", 3)]


def test_any_resource_is_explained_with_all_its_facts(spark):
    facts = [("urn:c", f"urn:p{i:02}", f"v{i:02}", "literal", None, None) for i in range(25)]
    facts += [("urn:c", RDF_TYPE, "urn:T", "iri", None, None), ("urn:c", PREF_LABEL, "C", "literal", None, None)]
    graph = frame(spark, "s string, p string, o string, o_kind string, o_datatype string, o_lang string", *facts)
    ids = frame(spark, "id string", ("urn:c",), ("urn:unknown",))
    got = context.explain(graph, ids).orderBy("step").collect()
    assert [r["statement"] for r in got] == [f"p{i:02} = v{i:02}" for i in range(25)]
    assert context.explain(graph, ids, facts_shown=3).count() == 3


def test_pages_and_lists_are_per_tenant(spark):
    waiting = frame(
        spark, "tenant_id string, proposal_id string, status string",
        *[(t, f"p{i:03}", "HUMAN_REVIEW") for t in ("t1", "t2") for i in range(70)],
    )
    page = review.review_page(waiting, page=60).collect()
    assert len(page) == 120 and {r["next_cursor"] for r in page} == {"p059"}
    rest = review.review_page(waiting, after="p059", page=60).collect()
    assert len(rest) == 20 and {r["next_cursor"] for r in rest} == {None}
    counts = registry.counts_by(waiting, "status", ("HUMAN_REVIEW", "APPROVED"))
    assert rows(counts) == [("t1", "APPROVED", 0), ("t1", "HUMAN_REVIEW", 70), ("t2", "APPROVED", 0), ("t2", "HUMAN_REVIEW", 70)]


def test_a_side_beyond_the_bound_is_never_broadcast(spark):
    """Sizes of compressed files are no reason: the rows would have to fit on the driver."""
    rows = spark.range(50).selectExpr("id AS k", "id AS v")
    joined = small_join(rows, rows.select("k"), "k", max_rows=10)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50


def test_validation_stores_only_the_classes_that_shapes_ask_for(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(shapes, "stored", lambda df, name: kept.append(df) or df)
    rows = [("a", RDF_TYPE, "Account"), ("a", RDF_TYPE, "Other"), ("b", RDF_TYPE, "Person"), ("a", "owner", "b"), ("a", "owner", "c")]
    graph = spark.createDataFrame([(s, p, o, "iri", None, None) for s, p, o in rows], "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    frame = shapes.shape_frame(spark, [shapes.Constraint("S", "Account", "owner", "class", "Person")])
    report = shapes.validate(graph, frame, local_frame(spark, [], "s string, p string, o string"))
    assert [(r["focus_node"], r["value"]) for r in report.collect()] == [("a", "c")]
    assert sorted(r["cls"] for r in kept[0].collect()) == ["Account", "Person"]


def test_shapes_move_only_the_types_they_ask_for(spark):
    """types of other classes are dropped in the scan, before any shuffle."""
    graph = spark.range(1_000).selectExpr(
        "concat('urn:n', id) s", f"'{RDF_TYPE}' p", "if(id % 10 = 0, 'urn:A', 'urn:B') o", "'iri' o_kind",
        "cast(null as string) o_datatype", "cast(null as string) o_lang",
    )
    shape = shapes.shape_frame(spark, [shapes.Constraint("urn:S", "urn:A", "urn:p", "minCount", "1")])
    types = shapes.types_of(graph)
    moved = shapes.targets(types, shape)
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.rindex("Aggregate"):]  # below the shuffle that makes types a set
    assert moved.count() == shapes.count_violations(graph, types, shape).count() == 100


def test_review_queue_hashes_only_the_runs_of_its_page(spark, monkeypatch):
    """three tenants, 60 proposals each; all other orders are only looked at for their state."""
    from govgraph.plans import governance, suite

    kept = {}

    def watched(df, name):
        kept[name] = stored(df, name)
        return kept[name]

    monkeypatch.setattr(governance, "stored", watched)
    found = suite.QUERIES["review_queue"](spark, "/root/testdata/sf0.001")
    assert 0 < found.count() <= kept["runs"].count() <= 180


def test_inferred_types_are_made_a_set_once(spark):
    """no set of subjects is held besides the set of types that is asked for."""
    graph = spark.range(1_000).selectExpr(
        "concat('urn:n', id % 100) s", "'urn:p' p", "concat('urn:o', id % 50) o", "'iri' o_kind",
        "cast(null as string) o_datatype", "cast(null as string) o_lang",
    )
    rules = frame(spark, "p string, side string, cls string", ("urn:p", "s", "urn:A"), ("urn:p", "s", "urn:B"), ("urn:p", "o", "urn:C"))
    for inferred, n in ((inference.infer_domain(graph, rules), 200), (inference.infer_range(graph, rules), 50)):
        types = inferred.select("s", "o").distinct()
        assert types._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
        assert types.count() == n


def test_context_of_few_resources_moves_only_their_triples(spark, monkeypatch):
    """the graph is neither written nor dealt anew; labels are looked up for the shown objects alone."""
    from govgraph.operators import triples
    from govgraph.plans import suite

    def write(graph, path):
        raise AssertionError("the whole graph is written")

    monkeypatch.setattr(triples, "write_graph", write)
    found = suite.QUERIES["concept_context"](spark, "/root/testdata/sf0.001")
    assert found.count() > 25


def joined_sides(df):
    """The columns that each side of the first join of a plan hands over."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    return [plan.children().apply(n).output().mkString(",") for n in (0, 1)]


def test_reviews_move_codes_and_not_the_texts_of_runs(spark, monkeypatch):
    """F8, F9: neither frozen proposals nor gates pass the join with runs; orders meet outcomes before they are made wide."""
    from govgraph.plans import governance

    monkeypatch.setattr(governance, "stored", lambda df, name: df)
    sides = joined_sides(governance.bound_reviews(spark, "/root/testdata/sf0.001").select("proposal_id", "reason_codes", "eligible"))
    assert "run_reasons" in sides[1]
    for wide in ("frozen_proposal#", "gate_results", "models", "evidence", "frozen_proposal_sha256"):
        assert wide not in sides[0] + sides[1]
    assert "evidence" not in joined_sides(governance.order_runs(spark, "/root/testdata/sf0.001"))[0]


def test_only_broken_values_are_moved_to_their_targets(spark):
    """20 of 1,000 values break a bound; the other 980 stay where they are read, and nodes are dealt once."""
    graph = spark.range(1_000).selectExpr("concat('urn:n', id) s", "'urn:p' p", "cast(id as string) o", "'literal' o_kind", "'urn:d' o_datatype", "cast(null as string) o_lang")
    types = spark.range(1_000).selectExpr("concat('urn:n', id) node", "'urn:A' cls")
    shape = shapes.shape_frame(spark, [
        shapes.Constraint("s", "urn:A", "urn:p", "maxInclusive", "979"), shapes.Constraint("s", "urn:A", "urn:p", "maxCount", "1"),
        shapes.Constraint("s", "urn:A", "urn:p", "hasValue", '"7"^^<urn:d>'), shapes.Constraint("s", "urn:A", "urn:q", "minCount", "1"),
    ])
    found = shapes.value_violations(graph, types, shape)
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join" or "LeftSemi" not in plan.toString().splitlines()[0]:
        plan = plan.children().apply(0)
    moved = plan.children().apply(0).toString().splitlines()[0]
    assert "CASE WHEN" in moved and "maxInclusive" in moved and found.count() == 20  # the check is below the join with targets
    counts = shapes.count_violations(graph.unionByName(graph), types, shape)
    assert rows(counts.groupBy("component").count()) == [("hasValue", 999), ("minCount", 1_000)]
    twice = counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(focus")
    assert twice <= 3


def test_artifacts_and_decisions_are_dealt_once_each(spark):
    """no set of artifacts is sorted before it is moved, and none is moved again for the join."""
    from govgraph.plans import release_queries

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = release_queries.chain_findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Aggregate" not in plan[plan.rindex("Exchange hashpartitioning"):]


def test_a_graph_is_made_a_set_in_parts_of_bounded_size(spark, monkeypatch):
    """parts grow in number with the triples, and nothing is held as a set before it is dealt."""
    graph = spark.range(1_000).selectExpr(
        "concat('urn:n', id) s", "'urn:p' p", "concat('urn:o', id % 50) o", "'iri' o_kind",
        "cast(null as string) o_datatype", "cast(null as string) o_lang",
    )
    axioms = frame(spark, "s string, p string, o string", ("urn:p", "http://www.w3.org/2000/01/rdf-schema#domain", "urn:A"))
    monkeypatch.setattr(inference, "PART_ROWS", 100, raising=False)
    full = inference.materialize(graph.unionByName(graph), axioms)
    assert rows(full.groupBy("inferred").count()) == [(False, 1_000), (True, 1_000)]
    assert full.rdd.getNumPartitions() == 40
    plan = full._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("Exchange hashpartitioning"):].splitlines()
    assert "REPARTITION_BY_NUM" in dealt[0] and "Aggregate" not in dealt[1]
