"""URL filters, vectors, language, quality, pages and the pipeline: plain versions, held-out rows and odd inputs."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from govgraph.llm import language, near_vectors, pages, quality, urls
from govgraph.llm.common import table

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


def plain_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_urls(spark):
    given = [
        "https://A.Example.NET/en/x?y#z", "http://example.net/fr/", "http://net/", "http://planet/", "ftp://x.org/fr/1", "http://x.org",
        "http://www.example.com/de/a#b", "http://www.example.com/de", "nothing", "", None, "://", "http://", "http://ÄB.org/Fr/",
        "http://a.net?q=/en/", "http://a.net/", "http://a.net/", "a://b://c.net/d", "http://casino-win.example.org/en/1",
        *[f"http://site{chr(97 + i)}.example.org/en/{i}" for i in range(12)],
    ]
    rows = [(i, u, f"<title>the site word {i}</title>", "x") for i, u in enumerate(given)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, host string")
    got = urls.judged(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        host, path, best = plain_url(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        if best:
            assert r["verdict"] == best[1]
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert verdict[18] == "block" and all(verdict[i] == "allow" for i in range(19, len(given)))
    assert urls.judged(df.limit(0)).collect() == []


def test_viterbi_splits_by_the_dictionary():
    counts = {"free": 40, "bets": 30, "be": 50, "fr": 5, "ee": 5, "ts": 5}
    name, total = "freebets", 1000.0
    known = {(i, n): np.log(counts[name[i : i + n]] / total) for i in range(8) for n in range(1, 9 - i) if name[i : i + n] in counts}
    assert urls.viterbi(name, known, total) == ["free", "bets"]
    assert urls.viterbi("", {}, total) == []


def plain_vectors(rows, least=near_vectors.COSINE):
    usable = {}
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = (label, np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)))
    links = {i: set() for i, *_ in rows}
    for i, (a, x) in usable.items():
        for j, (b, y) in usable.items():
            if i != j and a == b and len(x) == len(y) and x @ y >= least:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        base = rng.normal(size=16)
        for _ in range(1 + c % 7):
            rows.append((len(rows), c % 3, (base + rng.normal(scale=0.08, size=16)).tolist()))
    hot = rng.normal(size=16)
    rows += [(len(rows) + k, 1, (hot + rng.normal(scale=0.07, size=16)).tolist()) for k in range(150)]
    n = len(rows)
    rows += [
        (n, None, rows[0][2]), (n + 1, 0, None), (n + 2, 0, [0.0] * 16), (n + 3, 0, [float("nan")] * 16), (n + 4, 0, [None] * 16),
        (n + 5, 0, [float("inf")] * 16), (n + 6, 0, []), (n + 7, 0, rows[0][2]), (n + 8, 0, rows[0][2][:8]), (n + 9, 2, rows[0][2]),
    ]
    monkeypatch.setattr(near_vectors, "SHARD_VECTORS", 64)  # several shards and blocks of a label
    monkeypatch.setattr(near_vectors, "QUERY_VECTORS", 100)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, n string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect()}
    as_stored = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert got == plain_vectors(as_stored)
    assert near_vectors.near_vectors(df.limit(0)).collect() == []


def test_repeated_ids_and_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, other = rng.normal(size=8).tolist(), rng.normal(size=8).tolist()
    close = [x + 0.001 for x in base]
    rows = [(1, 0, base), (1, 0, base), (2, 0, close), (3, 0, other)]
    rows += [(100 + k, 1, base) for k in range(500)] + [(700 + k, 1, rng.normal(size=8).tolist()) for k in range(60)]
    rows += [(100, 1, base)] * 50 + [(900, 1, close), (5, 2, base), (5, 2, other), (6, 2, close), (7, 2, other), (8, 3, base), (8, 3, close)]
    monkeypatch.setattr(near_vectors, "SHARD_VECTORS", 128)
    monkeypatch.setattr(near_vectors, "QUERY_VECTORS", 200)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in near_vectors.near_vectors(df).collect())
    single = {(i, label, tuple(v)) for i, label, v in rows}
    unit = {r: np.array(r[2]) / np.linalg.norm(r[2]) for r in single}
    links = {(a, b) for a in single for b in single if a[1] == b[1] and a[0] != b[0] and unit[a] @ unit[b] >= 0.98}
    count, parent = {}, {i: i for i, _, _ in rows}
    for a, b in links:
        count[a[0]] = count.get(a[0], 0) + 1
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(parent[a[0]], parent[b[0]])
            changed |= parent[a[0]] != low or parent[b[0]] != low
            parent[a[0]] = parent[b[0]] = low
    assert got == sorted((i, count.get(i, 0), parent[i], parent[i] == i) for i, _, _ in rows)
    assert count[1] == 1 and count[2] == 1 and count[900] == 500


def test_graph_search_finds_what_reading_all_finds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[300:600] = x[:300] + rng.normal(scale=0.1, size=(300, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = near_vectors.Graph(x)
    found = list(near_vectors.audited(graph, x, np.full(900, -1), 0.97))
    hit = total = 0
    for q, near in zip(x, found, strict=True):
        truth = set(np.flatnonzero(x @ q >= 0.97).tolist())
        assert set(near.tolist()) <= truth
        hit, total = hit + len(truth & set(near.tolist())), total + len(truth)
    assert hit >= 0.99 * total


def held(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


@needs_tables
def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language.languages(docs).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.99 * len(tested)


def test_language_of_odd_texts(spark):
    rows = [(i, t, "aa" if i % 2 else "bb", "x") for i, t in enumerate(["lorem ipsum dolor sit amet", "vrba dub jedle buk habr"] * 20)]
    rows += [(100, None, "aa", "x"), (101, "", None, "x"), (102, "12 %&", "bb", "x"), (103, "ipsum dolor " * 9_000, None, "x"), (None, "jedle", None, "x")]
    df = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(df).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "bb" and got[None][0] == "aa"
    assert {r["lang_pred"] for r in language.languages(df.withColumn("lang", df["lang"].substr(9, 1)).where("lang <> ''")).collect()} <= {"und"}
    assert language.languages(df.limit(0)).collect() == []


def plain_phrases(text, sample):
    """Phrases of the greedy parse by substring search, stretch by stretch."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += n
        count += 1
    return count


def test_phrases_equal_substring_search():
    rng = random.Random(6)
    samples = {k: "".join(rng.choice(c) for _ in range(300)) for k, c in (("x", "abc"), ("y", "abcd"))}
    made = language._Automata(samples)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, language.STRETCH))) for _ in range(50)]
    got, _ = made.phrases(texts)
    for text, row in zip(texts, got.tolist(), strict=True):
        assert row[1] == plain_phrases(text, samples["y"])
        if "d" not in text:
            assert row[0] == plain_phrases(text, samples["x"])


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF.replace("0.01", "0.1"), "documents"), table(spark, SF.replace("0.01", "0.1"), "labels")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.quality(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows)
    clean = [r["predicted"] for r in rows if truth[r["doc_id"]] == 1]
    assert right >= 0.97 * len(rows) and sum(clean) >= 0.98 * len(clean)


def test_quality_of_odd_inputs(spark):
    rows = [(i, "good plain words here" if i % 2 else "BAD!! BAD!! $$$ %%%", "x") for i in range(80)] + [(90, None, "x"), (91, "", "x"), (None, "good", "x")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(80)] + [(90, None, "y"), (None, 1, "y"), (1, 1, "y")], "doc_id long, quality int, text string")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_main_text():
    model = pages.potentials({})
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><header>top</header><nav><ul><li><a href=x>menu</a></ul></nav>"
        "<article><h1>Head &amp; <i>li</i>ne</h1><p>One   two&nbsp;three<br>four<p>Five <a href='a>b'>six</a><script>var t='</p>';</script>"
        "<aside>side</aside><div class='user-comments'><p>I liked it</p></div><ul><li>item</ul></article><div class=ad>Buy</div><footer>end</footer>"
    )
    assert pages.main_text(page, model) == "Head & line One two three four Five six item"
    assert pages.main_text(None, model) == pages.main_text("", model) == pages.main_text("<p", model) == ""
    assert pages.main_text("<article>" + "<p>long &lt;text&gt; " * 20_000, model) == " ".join(["long <text>"] * 20_000)
    assert pages.main_text("<article>" + "<div>" * 5_000 + "deep", model) == "deep"


def test_marginals_equal_sums_over_all_labellings():
    from itertools import product
    from math import exp

    page = "<body><nav><a href=x>m</a></nav><article><p>some text here</p><aside>s</aside></article><p>tail</p></body>"
    model = pages.potentials(pages.count_labelled([page] * 3))
    blocks, _ = pages.parse(page)
    weight = np.zeros(len(blocks))
    total = 0.0
    for ys in product((0, 1), repeat=len(blocks) - 1):
        y = (0, *ys)
        p = 1.0
        for i in range(1, len(blocks)):
            p *= model["pair"][(pages.kind(blocks[blocks[i].parent]), y[blocks[i].parent])][y[i]]
            p *= exp(sum(model["unary"][f][y[i]] for f in pages.features(blocks[i]) if f in model["unary"]))
        total += p
        weight += p * np.array(y)
    assert pages.marginals(blocks, model) == pytest.approx((weight / total).tolist(), abs=1e-9)


def test_pages(spark):
    rows = [(i, f"u{i}", f"<nav><a href=x>n</a></nav><article><p>text {i} é</p></article>", "x") for i in range(5)] + [(9, None, None, "x"), (None, "u", "", "x")]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in pages.extract(df).collect())
    assert got == sorted([(str(i), f"u{i}", f"text {i} é", 8) for i in (0, 0, 1, 2, 3, 4)] + [("9", None, "", 0), ("None", "u", "", 0)], key=str)
    assert pages.extract(df.limit(0)).collect() == []


@needs_tables
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline
    from govgraph.llm import decontaminate, identifiers, near_text

    docs = table(spark, SF.replace("0.01", "0.001"), "documents")
    frames = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    start, known, single, clean, redacted, mixed = [{r["doc_id"]: r for r in f.collect()} for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert set(known) == {i for i, r in start.items() if any(c.isalpha() for c in r["text"] or "")}
    classes = {r["doc_id"]: r["class_id"] for r in near_text.near_duplicates(frames[1]).collect()}
    assert set(single) == set(classes.values())
    leaks = {r["doc_id"] for r in decontaminate.decontaminate(frames[2], table(spark, SF, "benchmark")).collect() if r["contaminated"]}
    assert set(clean) == set(single) - leaks and set(redacted) == set(clean) == set(mixed)
    for i, r in redacted.items():
        assert (r["text"] == clean[i]["text"]) == (not identifiers.base_spans(clean[i]["text"]))
        assert r["n_chars"] == len(r["text"])
    assert sum(r["taken"] for r in mixed.values()) > 0
