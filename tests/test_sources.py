import csv
import hashlib
import io
import json
import random

import pytest
from govgraph.functions import canonical_json_text, canonical_sha256, valid_utc_day, valid_utc_instant
from govgraph.functions.digest import canonical_row_sha256
from govgraph.operators import catalog, ingest, profiling
from govgraph.plans.suite import QUERIES
from govgraph.sources import catalog as catalog_source
from govgraph.sources import files, lines, quads, sinks
from pyspark.sql import functions as F

CRM = """cif_no,party_id,party_type,legal_name,country,ubo,source_updated_at
CIF-0001,P-1001,PERSON,Alexei Petrov,LV,,2026-06-11T09:15:00Z
CIF-0002,P-1002,PERSON,Marta Rossi,IT,,2026-06-12T10:00:00Z
CIF-2001,LE-2001,LEGAL_ENTITY,Northstar Trading Ltd,GB,P-1001,2026-06-15T08:35:00Z
CIF-2002,LE-2002,LEGAL_ENTITY,Rossi Foods SL,ES,P-1002,2026-06-16T14:20:00Z
CIF-0042,P-HIST-1,PERSON,Historical Merge One,ES,,2020-01-01T00:00:00Z
CIF-0042,P-HIST-2,PERSON,Historical Merge Two,ES,,2020-01-02T00:00:00Z
"""


@pytest.fixture(scope="module")
def crm(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("crm") / "crm.csv"
    path.write_text(CRM)
    return files.read_csv_source(spark, str(path)).cache()


def test_crm_profile(crm):
    stats = profiling.dataset_stats(crm).first()
    assert (stats["record_count"], stats["field_count"], stats["non_null_cells"], stats["null_cells"]) == (6, 7, 38, 4)
    assert str(stats["completeness_rate"]) == "0.904762"
    columns = {r["column_name"]: r for r in profiling.column_stats(crm).collect()}
    assert columns["cif_no"]["distinct_count"] == 5 and str(columns["cif_no"]["uniqueness_ratio"]) == "0.833333"
    ubo = columns["ubo"]
    assert (str(ubo["null_rate"]), str(ubo["uniqueness_ratio"]), ubo["min_length"]) == ("0.666667", "0.333333", 6)
    assert profiling.pattern_stats(crm, "cif_no", r"^CIF-[0-9]{4}$").first()["match_count"] == 6
    counts = profiling.category_map(crm, "country", ["ES", "GB", "IT", "LV"]).first()["counts"]
    assert counts == {"ES": 3, "GB": 1, "IT": 1, "LV": 1}
    twice = profiling.uniqueness_counterexamples(crm, ["cif_no"], "party_id").collect()
    assert sorted((r["cif_no"], r["owner"], r["occurrences"]) for r in twice) == [
        ("CIF-0042", "P-HIST-1", 2),
        ("CIF-0042", "P-HIST-2", 2),
    ]
    links = profiling.distinct_counts(crm, {"parties": "party_id"}, {"ubo_links": "ubo"})
    assert {r["counter"]: r["n"] for r in links.collect()} == {"parties": 6, "ubo_links": 2}


def test_payment_and_feature_profiles(spark):
    paid = spark.createDataFrame([("125000.00",), ("17000.00",), ("320.00",)], "amount string")
    row = profiling.decimal_stats(paid, "amount").first()
    assert [str(v) for v in row[:3]] == ["320.00", "125000.00", "142320.00"]
    features = spark.createDataFrame(
        [("name:0.91|country:1.00|document:0.98",), ("name:1.00|country:1.00",)], "f string"
    )
    assert {r["feature"]: r["n"] for r in profiling.feature_counts(features, "f").collect()} == {
        "country": 2,
        "document": 1,
        "name": 2,
    }


def profile(spark, content, kind):
    frame = spark.createDataFrame([("p", bytearray(content.encode()), kind)], "path string, content binary, content_type string")
    return profiling.object_profile(frame).first()


def test_csv_profiles_handle_quotes_bom_and_newlines(spark):
    row = profile(spark, '﻿id,"full ""legal"" name","a,b"\n1,"x\ny",2\n\n  \n2,z,3', "text/csv")
    assert row["column_names"] == ["id", 'full "legal" name', "a,b"] and row["record_count"] == 2
    row = profile(spark, ",".join(["n" * 201] + [f"c{i}" for i in range(150)]) + "\n", "text/csv; charset=utf-8")
    assert len(row["column_names"]) == 151 and row["column_names"][1] == "c0" and row["record_count"] == 0


def test_json_profiles(spark):
    assert profile(spark, '[{"b":1,"a":2},{"c":3}]', "application/json")["column_names"] == ["a", "b"]
    assert profile(spark, '{"b":1}', "application/json")["record_count"] == 1
    assert profile(spark, "[1, 2]", "application/json")["column_names"] == []
    lines = profile(spark, '{"z":1,"a":2}\n\n{"q":1}\n', "application/x-ndjson")
    assert (lines["record_count"], lines["column_names"]) == (2, ["a", "z"])
    assert profile(spark, "%PDF-1.7 body", "application/pdf")["record_count"] is None
    assert profile(spark, "a\n\n b \n", "text/plain")["record_count"] == 2
    assert not profile(spark, "x", "image/png")["supported"]


def test_long_quoted_text_does_not_overflow(spark):
    big = '"' + 'a""b\n' * 200_000 + '"'
    assert profile(spark, f"h\n{big}\n", "text/csv")["record_count"] == 1


def test_headers_are_checked(spark, tmp_path):
    for header in ("a,a", "a,,b"):
        path = tmp_path / "bad.csv"
        path.write_text(header + "\n1,2\n")
        with pytest.raises(files.SourceFormatError):
            files.read_csv_source(spark, str(path))


def test_jsonl_lines_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a":1}\n\n{bad\n[1]\n{"a":2}\n')
    rows = files.read_jsonl_source(spark, str(path)).orderBy("line").collect()
    assert [(r["line"], r["malformed"]) for r in rows] == [(1, False), (3, True), (4, True), (5, False)]
    with pytest.raises(Exception, match="line 3"):
        files.require_well_formed(files.read_jsonl_source(spark, str(path))).collect()


def test_sanctions_and_kyc(spark, tmp_path):
    sanctions = tmp_path / "s.json"
    record = {"id": "EU-998", "name": "Alexei Petrov", "countries": ["LV"]}
    sanctions.write_text(json.dumps({"generatedAt": "2026-06-20T06:00:00Z", "records": [record]}, indent=1))
    row = files.read_json_records(spark, str(sanctions), "records").first()
    assert row["id"] == "EU-998" and row["countries"] == ["LV"]
    kyc = tmp_path / "k.txt"
    kyc.write_text("RECORD\n\nLegal entity: Northstar Trading Ltd (LE-2001)\nRegistered country: GB\nDeclared ownership: 68%\n")
    lines = files.read_text_lines(spark, str(kyc))
    labels = {"Legal entity": "entity", "Declared ownership": "share"}
    row = files.extract_labelled_fields(lines, labels).first()
    assert row["entity"] == "Northstar Trading Ltd (LE-2001)" and row["share"] == "68"
    assert row["share_locator"].endswith("#line=5")


def test_objects_and_digests(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.txt").write_text("hello")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_objects(spark, str(tmp_path)).collect()}
    assert rows["a.pdf"]["has_pdf_signature"] and not rows["b.txt"]["has_pdf_signature"]
    assert rows["b.txt"]["sha256"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_nquads_round_trip(spark, tmp_path):
    rows = [
        ("urn:a", "urn:p", 'quo"te \\n \\\\ back\nline\ttab', "literal", None, "en"),
        ("_:b1", "urn:p", "1.50", "literal", "http://www.w3.org/2001/XMLSchema#decimal", None),
        ("urn:a", "urn:q", "_:b1", "bnode", None, None),
        ("urn:a", "urn:q", "urn:c#d", "iri", None, None),
    ]
    frame = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    quads.write_nquads(frame, str(tmp_path / "q"))
    back = quads.read_nquads(spark, str(tmp_path / "q")).select(*frame.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    bad = spark.createDataFrame([("<a> b .",), ("# note",), ("",), ("<a> <b> <c> <g> .",)], "value string")
    parsed = quads.parse_nquads(bad).collect()
    assert [(r["malformed"], r["graph"]) for r in parsed] == [(True, None), (False, "g")]


def test_append_only_sink(spark, tmp_path):
    schema = "k int, h string"
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "x"), (3, "y")], schema)
    assert [tuple(r) for r in sinks.append_only_sink(first, path, ["k"], "h").select("k", "h").collect()] == [(3, "y")]
    again = spark.createDataFrame([(1, "a"), (2, "changed"), (4, "d")], schema)
    assert [r["k"] for r in sinks.append_only_sink(again, path, ["k"], "h").collect()] == [2]
    kept = sorted(map(tuple, spark.read.parquet(path).collect()))
    assert kept == [(1, "a"), (2, "b"), (3, "x"), (4, "d")]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(first, path)


def test_instants(spark):
    cases = {
        "2026-02-28": (True, False),
        "2026-02-30": (False, False),
        "2024-02-29T23:59:59Z": (False, True),
        "2026-02-29T00:00:00Z": (False, False),
        "2026-01-01T00:00:00.123456789Z": (False, True),
        "2026-01-01T24:00:00Z": (False, False),
        "2026-01-01T00:00:00+00:00": (False, False),
        "2026-01-01T00:00:00Z\n": (False, False),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    got = frame.select("v", valid_utc_day(F.col("v")).alias("d"), valid_utc_instant(F.col("v")).alias("i"))
    assert {r["v"]: (r["d"], r["i"]) for r in got.collect()} == cases


def test_canonical_json(spark):
    cases = {
        '{"b": 1.0, "a": [1, 2.50, null], "B": {"y": true, "x": "é"}}': '{"B":{"x":"é","y":true},"a":[1,2.5,null],"b":1}',
        '{"a":1,"a":2}': None,
        "nope": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["c"] for r in frame.select("v", canonical_json_text(F.col("v")).alias("c")).collect()}
    assert got == cases


def snapshot(**changes):
    def column(table, name, position, kind="uuid"):
        return {"table_schema": "kyc", "table_name": table, "column_name": name, "ordinal_position": position, "data_type": kind, "is_nullable": "NO"}

    base = {
        "catalog_schema_version": "1.0",
        "database": "kyc_core",
        "server_version": "16.4",
        "collected_at": "2026-07-01T06:30:00Z",
        "schemas": [{"schema_name": "kyc"}],
        "tables": [
            {"table_schema": "kyc", "table_name": t, "table_type": "BASE TABLE", "row_estimate": 10} for t in ("customers", "accounts")
        ],
        "columns": [column("customers", "customer_id", 1), column("accounts", "account_id", 1), column("accounts", "customer_id", 2), column("accounts", "flags", 3, "jsonb")],
        "primary_keys": [{"table_schema": "kyc", "table_name": "customers", "constraint_name": "pk", "column_names": ["customer_id"]}],
        "foreign_keys": [
            {
                "table_schema": "kyc",
                "table_name": "accounts",
                "constraint_name": "fk",
                "column_names": ["customer_id"],
                "referenced_schema": "kyc",
                "referenced_table": "customers",
                "referenced_columns": ["customer_id"],
            }
        ],
    }
    return base | changes


def load_catalog(spark, tmp_path, **changes):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(snapshot(**changes)))
    documents = spark.read.text(str(path), wholetext=True).withColumn("path", F.lit("catalog"))
    return catalog_source.read_catalog(spark, str(path)), documents


def test_catalog_profile(spark, tmp_path):
    sets, documents = load_catalog(spark, tmp_path)
    assert catalog.catalog_policy_violations(sets, documents).isEmpty()
    made = catalog.catalog_profile(sets, "kyc_core")
    stats = made["statistics"].first()
    assert (stats["tables_count"], stats["columns_count"], stats["foreign_keys_count"]) == (2, 4, 1)
    tables = {r["table_id"]: r for r in made["tables"].collect()}
    assert tables["kyc.accounts"]["column_count"] == 3 and tables["kyc.customers"]["primary_key"]["column_names"] == ["customer_id"]
    kinds = {r["column_name"]: r["logical_type"] for r in made["columns"].collect()}
    assert kinds["flags"] == "object"


@pytest.mark.parametrize(
    ("changes", "rule"),
    [
        ({"schemas": [{"schema_name": "other"}]}, "TABLE_WITHOUT_SCHEMA"),
        ({"schemas": [{"schema_name": "kyc", "Sample_Rows": []}]}, "FORBIDDEN_KEY"),
        ({"schemas": [{"schema_name": " "}, {"schema_name": "kyc"}]}, "EMPTY_NAME"),
        ({"columns": []}, "PRIMARY_KEY_COLUMN"),
        ({"schemas": [{"schema_name": "kyc"}] * 17}, "LIMIT_EXCEEDED"),
        ({"extra": 1}, "UNKNOWN_KEY"),
    ],
)
def test_catalog_policy(spark, tmp_path, changes, rule):
    sets, documents = load_catalog(spark, tmp_path, **changes)
    limits = {"schemas": 16}
    rules = {r["rule"] for r in catalog.catalog_policy_violations(sets, documents, limits).collect()}
    assert rule in rules
    unlimited = {r["rule"] for r in catalog.catalog_policy_violations(sets, documents).collect()}
    assert unlimited == rules - {"LIMIT_EXCEEDED"}


def test_quarantine_order(spark):
    rows = [
        ("tenants/t/uploads/s/f.csv", 10, "text/csv; charset=utf-8", "t"),
        ("tenants/t/uploads/s/f.csv", 0, "image/png", "x"),
        ("tenants/t/uploads/s/f.csv", 10, "image/png", "x"),
        ("tenants/t/uploads/s/f.csv", 10, "text/csv", None),
        ("other/path", 10, "text/csv", "t"),
        ("tenants/../uploads/s/f", 10, "text/csv", "t"),
    ]
    frame = spark.createDataFrame(rows, "object_name string, size_bytes long, content_type string, metadata_tenant string")
    got = [(r["status"], r["reason"]) for r in ingest.quarantine(frame).collect()]
    assert got == [
        ("QUEUED", None),
        ("QUARANTINED", "INVALID_OBJECT_SIZE"),
        ("QUARANTINED", "UNSUPPORTED_CONTENT_TYPE"),
        ("QUARANTINED", "TENANT_METADATA_MISMATCH"),
        ("IGNORED", None),
        ("INVALID_SEGMENT", None),
    ]




def test_an_append_reads_only_files_that_may_hold_its_keys(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    for part in range(4):
        rows = [(f"k{part}-{n}", n, f"h{n}") for n in range(300)] + [(None, part, "no key")]
        assert sinks.append_only_sink(spark.createDataFrame(rows, "k string, n int, h string").coalesce(1), path, ["k", "n"], "h").count() == 0
    files = spark.read.parquet(path).inputFiles()
    ask = lambda rows: sinks.files_that_may_hold(spark, path, spark.createDataFrame(rows, "k string, n int"), ["k", "n"])
    assert len(ask([("k2-7", 7)])) < len(files) and len(ask([("zz", 1)])) == 0
    for k, n in [("k0-0", 0), ("k1-299", 299), ("k3-150", 150)]:
        held = {r["_p"] for r in spark.read.parquet(path).filter(F.col("k").eqNullSafe(k) & (F.col("n") == n)).select(F.col("_metadata.file_path").alias("_p")).collect()}
        assert {sinks._file_key(f) for f in held} <= {sinks._file_key(f) for f in ask([(k, n)])}
    # Files that no index knows are read.
    spark.createDataFrame([("other", 1, "x")], "k string, n int, h string").write.mode("append").parquet(path)
    conflict = spark.createDataFrame([("other", 1, "y"), ("k1-5", 5, "h5"), ("new", 1, "z")], "k string, n int, h string")
    read = []
    original = sinks.files_that_may_hold
    monkeypatch.setattr(sinks, "files_that_may_hold", lambda *a: read.append(original(*a)) or read[-1])
    assert [r["k"] for r in sinks.append_only_sink(conflict, path, ["k", "n"], "h").collect()] == ["other"]
    assert len(read) == 1 and len(read[0]) < len(files)
    assert spark.read.parquet(path).count() == 4 * 300 + 2


def test_append_to_partitions_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BLOCK_KEYS", 16)
    path = str(tmp_path / "table")
    rows = spark.range(500).selectExpr("id AS k", "id % 3 AS part", "cast(id AS string) AS h")
    assert sinks.append_only_sink(rows, path, ["k"], "h", ["part"]).count() == 0
    assert sinks.append_only_sink(rows, path, ["k"], "h", ["part"]).count() == 0
    other = rows.filter("k < 3").withColumn("h", F.lit("other"))
    assert sinks.append_only_sink(other, path, ["k"], "h", ["part"]).count() == 3
    assert spark.read.parquet(path).count() == 500


@pytest.fixture
def tiny_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_are_numbered_by_many_tasks(spark, tmp_path, tiny_splits):
    rng = random.Random(2)
    wanted = {}
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = ["".join(rng.choices("ab é\t", k=rng.randrange(0, 90))) + rng.choice(["", "\r"]) for _ in range(60)]
        (tmp_path / name).write_bytes(("\ufeff" * (name == "b.txt") + "\n".join(lines) + "\n" * (name == "c.txt")).encode())
        wanted.update({(name, n + 1): line.removesuffix("\r") for n, line in enumerate(lines) if line.strip()})
    got = files.read_text_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 10
    rows = got.collect()
    assert {(r["path"].rsplit("/", 1)[1], r["line"]): r["value"] for r in rows} == wanted and len(rows) == len(wanted)
    assert all(r["locator"].endswith(f"{r['line']}") for r in rows)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.txt").write_text("")
    assert files.read_text_lines(spark, str(tmp_path / "empty")).collect() == []


def test_jsonl_lines_keep_their_numbers_over_splits(spark, tmp_path, tiny_splits):
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"k": n}) if n % 9 else "[broken" for n in range(1, 150)))
    rows = files.read_jsonl_source(spark, str(tmp_path)).filter("malformed").collect()
    assert sorted(r["line"] for r in rows) == list(range(9, 150, 9))


def csv_cell(rng):
    kind = rng.randrange(6)
    plain = "".join(rng.choices("abc é", k=rng.randrange(0, 12)))
    if kind == 0:
        return plain
    inner = "".join(rng.choices(["a", "b", ",", '""', "\n", "\r\n", " ", "é"], k=rng.choice([3, 8, 120])))
    return f'"{inner}"' if kind < 4 else plain + rng.choice(["", 'x"y', "'"])


def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, tiny_splits):
    rng, wanted = random.Random(8), []
    for name in ("a.csv", "b.csv"):
        rows = [",".join(csv_cell(rng) for _ in range(3)) for _ in range(45)]
        rows[7:7] = ["", "  ", ",,", '"","",""']
        ending = "\r\n" if name == "b.csv" else "\n"
        text = ending.join(["k,l m,n", *rows, ""])
        (tmp_path / name).write_bytes(("\ufeff" + text if name == "b.csv" else text).encode())
        wanted += [tuple(c or None for c in r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if any(c.strip() for c in r) or len(r) > 1]
    got = files.read_csv_source(spark, str(tmp_path), multi_line=True)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
    assert lines.split_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    one_task = spark.read.option("multiLine", True).option("escape", '"').option("header", True).csv(str(tmp_path / "a.csv"))
    own = files.read_csv_source(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert sorted(map(str, own.collect())) == sorted(str(r) for r in one_task.collect() if r["l m"] or r["n"] or (r["k"] or "").strip() or r["k"] is None)


def test_empty_texts_nulls_and_null_characters_go_through_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n1,"\x00"\n2,"a""\x00""b"\n3,"\x00""x"\n')
    rows = {r["h1"]: r["h2"] for r in files.read_csv_source(spark, str(tmp_path / "a.csv"), multi_line=True).collect()}
    assert rows == {"1": "\x00", "2": 'a"\x00"b', "3": '\x00"x'}
    texts = [None, "", " ", '""', '"\x00"', "a\r\nb", "\n", "\\"]
    docs = [(n, text, [None, "", "en"][n % 3]) for n, text in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {(str(n), lang, None if text is None else hashlib.sha256(text.encode()).hexdigest()) for n, text, lang in docs}
    assert {tuple(r) for r in QUERIES["csv_source"](spark, str(tmp_path)).collect()} == wanted


def test_a_record_over_many_splits_and_other_headers(spark, tmp_path, tiny_splits):
    cell = "\n".join(f"row {n}, and" for n in range(80))
    (tmp_path / "a.csv").write_text(f'h1,h2\n1,"{cell}"\n2,"b"\n')
    rows = {r["h1"]: r["h2"] for r in files.read_csv_source(spark, str(tmp_path / "a.csv"), multi_line=True).collect()}
    assert rows == {"1": cell, "2": "b"}
    starts = {r["value"][:2]: r["line"] for r in lines.quoted_records(spark, str(tmp_path / "a.csv")).collect()}
    assert starts == {"h1": 1, "1,": 2, "2,": 82}
    (tmp_path / "b.csv").write_text('h1,h3\n1,"x"\n')
    with pytest.raises(Exception, match="header"):
        files.read_csv_source(spark, str(tmp_path), multi_line=True).collect()


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [("a,b", False, False), ('"a', False, True), ('"a""', False, True), ('"a"', False, False), ('a"b', False, False), ('x,"y', False, True),
     ('y",z', True, False), ("still", True, True), ('y","z', True, True), ('""', True, True), ('"', True, False), (',"', False, True)],
)
def test_quotes_of_a_line(line, inside, after):
    assert lines.ends_inside(line, inside) is after


def test_a_changed_line_is_found_down_the_tree(spark, tmp_path):
    columns = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
    rows = [(f"urn:{n}", "urn:p", f"v{n % 50}", "literal", None, None) for n in range(400)] + [("urn:x", "urn:p", "same", "literal", None, None)] * 300
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    quads.write_nquads(spark.createDataFrame(rows, columns), first, depth=2)
    quads.write_nquads(spark.createDataFrame(rows[::-1], columns).repartition(3), second, depth=2)
    assert quads.dump_digest(spark, first) == quads.dump_digest(spark, second)
    assert quads.changed_lines(spark, first, second).collect() == [] and quads.damaged_parts(spark, first).collect() == []
    changed = [*rows[:7], (*rows[7][:2], "new", *rows[7][3:]), *rows[8:-1]]
    third = str(tmp_path / "c")
    quads.write_nquads(spark.createDataFrame(changed, columns), third, depth=3)
    assert quads.dump_digest(spark, first) != quads.dump_digest(spark, third)
    found = sorted((r["left_count"], r["right_count"]) for r in quads.changed_lines(spark, first, third).collect())
    assert found == [(0, 1), (1, 0), (300, 299)]
    part = next((tmp_path / "a").glob("part-*.txt"))
    text = part.read_text()
    part.write_text(text.replace(text.splitlines()[0], "<urn:forged> <urn:p> <urn:q> ."))
    (tmp_path / "a" / f".{part.name}.crc").unlink(missing_ok=True)
    assert 1 <= quads.damaged_parts(spark, first).count() <= 2
    empty = str(tmp_path / "none")
    quads.write_nquads(spark.createDataFrame([], columns), empty)
    assert quads.dump_digest(spark, empty) is None and quads.damaged_parts(spark, empty).collect() == []


def test_catalog_over_jdbc(spark):
    """A server with the standard views, held in memory by the driver of the tests."""
    url = "jdbc:derby:memory:catalog;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = connection.createStatement().execute
    text = "VARCHAR(60)"
    views = {
        "schemata": ("schema_name", [("sales",), ("pg_catalog",), ("information_schema",)]),
        "tables": ("table_schema,table_name,table_type", [("sales", "orders", "BASE TABLE"), ("sales", "lines", "BASE TABLE"), ("pg_catalog", "x", "VIEW")]),
        "columns": (
            "table_schema,table_name,column_name,ordinal_position,data_type,is_nullable",
            [("sales", "orders", "tenant", 1, "text", "NO"), ("sales", "orders", "id", 2, "bigint", "NO"), ("sales", "lines", "tenant", 1, "text", "NO"),
             ("sales", "lines", "order_id", 2, "bigint", "YES"), ("pg_catalog", "x", "y", 1, "text", "YES")],
        ),
        "key_column_usage": (
            "table_schema,table_name,constraint_schema,constraint_name,column_name,ordinal_position,position_in_unique_constraint",
            # Out of order, and the referenced columns in another order than those that point at them.
            [("sales", "orders", "sales", "pk_o", "id", 2, None), ("sales", "orders", "sales", "pk_o", "tenant", 1, None),
             ("sales", "lines", "sales", "fk_l", "order_id", 1, 2), ("sales", "lines", "sales", "fk_l", "tenant", 2, 1)],
        ),
        "table_constraints": (
            "table_name,constraint_schema,constraint_name,constraint_type",
            [("orders", "sales", "pk_o", "PRIMARY KEY"), ("lines", "sales", "fk_l", "FOREIGN KEY"), ("lines", "sales", "ck", "CHECK")],
        ),
        "referential_constraints": (
            "constraint_schema,constraint_name,unique_constraint_schema,unique_constraint_name", [("sales", "fk_l", "sales", "pk_o")],
        ),
    }
    run("CREATE SCHEMA information_schema")
    for name, (columns, rows) in views.items():
        kinds = [f"{c} {'INT' if 'position' in c else text}" for c in columns.split(",")]
        run(f"CREATE TABLE information_schema.{name} ({', '.join(kinds)})")
        for row in rows:
            shown = ["NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row]
            run(f"INSERT INTO information_schema.{name} VALUES ({', '.join(shown)})")
    tables = "SELECT table_schema, table_name, table_type, CAST(7 AS BIGINT) AS row_estimate FROM information_schema.tables WHERE table_schema <> 'pg_catalog'"
    sets = catalog_source.read_catalog(spark, jdbc_options={"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, queries={"tables": tables})
    assert [r["schema_name"] for r in sets["schemas"].collect()] == ["sales"]
    assert sorted(r["table_name"] for r in sets["tables"].collect()) == ["lines", "orders"] and sets["columns"].count() == 4
    key = sets["primary_keys"].first()
    assert (key["table_name"], key["column_names"]) == ("orders", ["tenant", "id"])
    foreign = sets["foreign_keys"].first()
    assert (foreign["column_names"], foreign["referenced_table"], foreign["referenced_columns"]) == (["order_id", "tenant"], "orders", ["id", "tenant"])
    connection.close()


def test_numbers_that_are_not_finite_have_no_hash(spark):
    kinds = "a double, b array<struct<x: float, t: string>>, m map<string, double>, n int"
    good = spark.createDataFrame([(1.5, [(0.5, "NaN"), None], {"k": 2.0}, 3), (None, None, None, None)], kinds)
    hashes = [r[0] for r in good.select(canonical_row_sha256(good)).collect()]
    assert len(set(hashes)) == 2 and None not in hashes
    same = good.select(canonical_sha256({c: F.col(c) for c in good.columns}))
    assert [r[0] for r in same.collect()] == hashes
    nan, inf = float("nan"), float("inf")
    for row in [(nan, [], {}, 1), (1.0, [(-inf, "t")], {}, 1), (1.0, [], {"k": nan}, 1)]:
        bad = spark.createDataFrame([row], kinds)
        with pytest.raises(Exception, match="not finite"):
            bad.select(canonical_row_sha256(bad)).collect()


def test_objects_of_packs_are_those_of_files(spark, tmp_path):
    contents = {"a.pdf": b"%PDF-1.4 x\n\ny", "b.txt": "﻿hé\r\n \nlast\r".encode(), "c.txt": b"\n", "d.bin": b"\xff\n\xfe\n", "e.txt": b""}
    (tmp_path / "files").mkdir()
    for name, content in contents.items():
        (tmp_path / "files" / name).write_bytes(content)
    found = spark.read.format("binaryFile").load(str(tmp_path / "files"))
    packs = str(tmp_path / "packs")
    files.write_packs(found.coalesce(1), packs)
    assert len(list((tmp_path / "packs").glob("*.parquet"))) == 1
    columns = ["path", "byte_size", "sha256", "media_type", "has_pdf_signature"]
    wanted = files.read_objects(spark, str(tmp_path / "files")).select(*columns)
    assert {tuple(r) for r in files.read_packed_objects(spark, packs).select(*columns).collect()} == {tuple(r) for r in wanted.collect()}

    def rows(lines):
        return sorted((r["path"].rsplit("/", 1)[1], r["line"], r["value"], r["locator"].rsplit("/", 1)[1]) for r in lines.collect())

    assert rows(files.packed_text_lines(spark, packs)) == rows(files.read_text_lines(spark, str(tmp_path / "files")))


@pytest.mark.parametrize("name", ["objects", "numbered_lines", "stream_arrivals"])
def test_documents_are_not_written_one_file_each(spark, name, monkeypatch):
    import __spark_entry__ as entry
    from govgraph.plans import operations_queries, source_queries

    made = []

    def seen(*args):
        made.append(source(*args))
        return made[-1]

    source = source_queries.document_packs
    monkeypatch.setattr(source_queries, "document_packs", seen)
    monkeypatch.setattr(operations_queries, "document_packs", seen)
    assert entry.queries()[name](spark, entry.SMOKE_DIR).count() > 0
    documents = spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet")
    assert len(spark.read.parquet(made[0]).inputFiles()) < documents.count() / 10
