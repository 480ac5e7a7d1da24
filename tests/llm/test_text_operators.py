"""Decontamination, mixing, identifiers, repeats and near-duplicates against plain versions, and odd inputs."""

import hashlib
import random
import re

import pytest

from govgraph.llm import decontaminate, identifiers, mixing, near_text, repeats

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, size long, term string, rank int"


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *([None] * (width - len(r)))) for r in rows], schema)


def prose(rng, n):
    return " ".join(rng.choice("alpha Beta gamma delta Épsilon zeta eta theta iota kappa".split()) for _ in range(n))


@pytest.fixture(scope="module")
def odd_documents():
    """Nulls, empty and long texts, ties, repeated rows; columns whose names operators use inside."""
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 80)), "en", f"s{i % 4}") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "de", "s1"), (102, "?!\n\t", "de", None), (103, prose(rng, 20_000), "en", "s0")]
    rows += [(104, rows[3][1], "en", "s0"), (105, rows[3][1] + " tail", "en", "s0"), (None, "no id at all", "en", "s1")]
    return rows + [rows[3], rows[3]]


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items):
    words = lowered(text)
    hit, names = set(), set()
    for item, other in items:
        b = lowered(other)
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(item))
    listed = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, odd_documents):
    long_text = odd_documents[43][1]
    items = [
        (1, " ".join(long_text.split()[500:530])), (2, odd_documents[5][1]), (3, "theta"), (4, None), (5, "..."),
        (10, "never seen words stand here one two three four five six"), (11, "THETA"), (2, odd_documents[5][1]),
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, phrase string")
    got = sorted(
        (str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
        for r in decontaminate.decontaminate(frame(spark, odd_documents), bench).collect()
    )
    assert got == sorted((str(d[0]), *plain_hits(d[1], items)) for d in odd_documents)


def test_decontaminate_with_nothing(spark, odd_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(frame(spark, odd_documents), none).collect())
    assert decontaminate.decontaminate(frame(spark, []), none).collect() == []


def test_proximity(spark):
    docs = frame(spark, [(1, "red " + "x " * 15 + "blue"), (2, "red " + "x " * 40 + "blue"), (3, "blue red")])
    bench = spark.createDataFrame([(1, "red blue")], "item_id long, text string")
    assert {r["id_key"] for r in decontaminate.proximity_matches(docs, bench).collect()} == {1, 3}


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(5)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 90_000]) for i in range(17)} | {None: 70}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(target)


def test_mix(spark, odd_documents):
    docs = frame(spark, odd_documents)
    rows = mixing.mix(docs).collect()
    assert sorted(rows, key=str) == sorted(mixing.mix(docs.repartition(5)).collect(), key=str)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in odd_documents)
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    for source, want in target.items():
        assert abs(taken[source] - want) <= max(3, 0.02 * want)
    assert mixing.mix(frame(spark, [])).collect() == []


def test_schedule_is_spread(spark):
    blocks = spark.createDataFrame([("a", 600), ("b", 300), ("c", 100)], "source string, quota long")
    rows = sorted((r["slot"], r["source"], r["rank"]) for r in mixing.schedule(blocks, slice_slots=64).collect())
    for name, quota in (("a", 600), ("b", 300), ("c", 100)):
        own = [r for _, s, r in rows if s == name]
        assert own == list(range(quota))
        for n in (100, 400, 900):  # any beginning holds about its share
            assert abs(sum(s == name for _, s, _ in rows[:n]) - n * quota / 1000) < 8


PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, form in enumerate(PLAIN):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (
                kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                or kind == 2 and 14 <= len(digits) <= 19 and identifiers.luhn(digits) or kind == 3 and 10 <= len(digits) <= 15
            )
            if fits:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_search():
    rng = random.Random(9)
    alphabet = ["@", ".", "a", "b-", "%", "+1", "4", "0", " ", "-", "(", ")", "255", "é", "4539 1488 0343 6467", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert identifiers.base_spans(text) == plain_spans(text)


def test_identifiers(spark, odd_documents):
    mail = "é😀 write to ann@example.com or +1 (555) 010-9999, from 10.0.0.1"
    rows = odd_documents + [(500, mail), (501, mail)]
    for r in identifiers.identifiers(frame(spark, rows)).collect():
        text = dict((d[0], d[1] or "") for d in rows)[r["doc_id"]]
        base = ",".join(f"{identifiers.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"] == base
    assert identifiers.identifiers(frame(spark, [])).collect() == []


def test_bootstrap_finds_what_seed_contexts_show(spark):
    seeds = [(i, f"please call us +1 555 01{i:02d} 1234 today") for i in range(12)]
    unseen = (50, "please call us 555 8123 4567 today")
    other = (51, "the answer is 555 8123 9999 exactly")
    rows = {r["doc_id"]: r for r in identifiers.identifiers(frame(spark, [*seeds, unseen, other])).collect()}
    assert rows[50]["n_phone"] == 0 and rows[50]["spans"] == "phone:15:28"
    assert rows[51]["spans"] == "" and rows[3]["spans"] == "phone:15:31"


def test_redaction(spark):
    docs = frame(spark, [(1, "mail a.b@c.de or 1.2.3.4!"), (2, "clean"), (3, None)])
    found = docs.join(identifiers.spans(docs).select("doc_id", "spans"), "doc_id")
    got = {r[0]: r[1] for r in found.select("doc_id", identifiers.redacted(found["text"], found["spans"])).collect()}
    assert got == {1: "mail [EMAIL] or [IP]!", 2: "clean", 3: None}


def plain_repeats(rows):
    """What is left of every text, by a dictionary of all strings of 50 bytes."""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            if doc is not None:
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if doc is not None and first[b[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(doc), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(spark, odd_documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(6))
    passages = [" ".join(word() for _ in range(n)) for n in (7, 8, 12, 30)]
    rows = [(d[0], d[1]) for d in odd_documents]
    for i in range(200, 260):
        parts = [rng.choice(passages)[rng.randrange(3) : 200 - rng.randrange(60)] if rng.random() < 0.4 else word() for _ in range(20)]
        rows.append((i, " ".join(parts)))
    rows += [(300, "ab" * 400), (301, "ab" * 90 + "\0" * 120), (302, "\0" * 70), (303, "q" * 49), (304, "q" * 50), (305, "q" * 51)]
    got = sorted(
        (str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        for r in repeats.remove_repeats(frame(spark, rows).repartition(6)).collect()
    )
    assert got == plain_repeats(rows)
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


def test_merged_runs_are_sorted_and_know_what_they_share():
    import numpy as np

    rng = random.Random(8)
    runs, plain = [], []
    for _ in range(7):
        rows = sorted(bytes(rng.choice(b"ab") for _ in range(repeats.KEY)) if rng.random() < 0.5 else bytes([rng.choice(b"ab")]) * repeats.KEY for _ in range(rng.randrange(30)))
        plain += rows
        if rows:
            matrix = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, repeats.KEY)
            shared, rest = repeats.front_coded(matrix)
            assert repeats.decoded(shared, rest) == rows
            runs.append((rows, shared.tolist()))
    run, at, shared = repeats.merged(runs)
    out = [runs[r][0][i] for r, i in zip(run, at, strict=True)]
    assert out == sorted(plain)
    for a, b, n in zip(out, out[1:], shared[1:], strict=False):
        same = next((i for i in range(repeats.KEY) if a[i] != b[i]), repeats.KEY)
        assert n == same


def test_near_duplicates(spark, odd_documents):
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(6):  # near copies of one source each, one group crowded
        base = fresh(300)
        ids = []
        for k in range(45 if g == 0 else 4):
            words = list(base)
            if k:
                words[rng.randrange(300)] = "changed"
            rows.append((len(rows) + 1000, " ".join(words)))
            ids.append(rows[-1][0])
        groups.append(ids)
    alone = [(len(rows) + 2000 + i, " ".join(fresh(200))) for i in range(30)]
    got = {str(r["doc_id"]): r for r in near_text.near_duplicates(frame(spark, rows + alone + odd_documents)).collect()}
    for ids in groups:
        assert {got[str(i)]["class_id"] for i in ids} == {min(ids)}
    assert all(got[str(i)]["kept"] and got[str(i)]["class_id"] == i for i, _ in alone)
    assert all(got[str(i)]["class_id"] == i for i in (100, 101, 102)) and got["None"]["class_id"] is None and got["None"]["kept"]
    assert got["104"]["class_id"] == 3 and not got["104"]["kept"]
    assert near_text.near_duplicates(frame(spark, [])).collect() == []


def plain_classes(texts, table):
    """The smallest id reachable over links, from all pairs."""
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and near_text.similarity(texts[a], texts[b], table) >= near_text.SIMILARITY:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_near_duplicates_in_a_boilerplate_family(spark):
    """Texts that share most of their words, with chains of copies among them: every band is a crowd."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, texts = fresh(520), {}
    for _ in range(110):
        words = shared + fresh(rng.randrange(75, 110))
        for _ in range(rng.randrange(1, 5)):
            texts[len(texts)] = " ".join(words)
            words = list(words)
            at = rng.randrange(520, len(words) - 35)
            words[at : at + 35] = fresh(35)
    docs = frame(spark, list(texts.items()))
    got = {r["doc_id"]: r["class_id"] for r in near_text.near_duplicates(docs).collect()}
    truth = plain_classes(texts, near_text.document_weights(docs))
    assert 1 < len(set(truth.values())) < len(texts)
    assert got == truth


def test_near_links_in_the_larger_crowds_only(spark):
    """Two copies without other links that share only bands that many share, and are in smaller crowds besides."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    n, docs, reps = near_text.SAMPLES // near_text.ROWS, [], []
    samples = bytes(4 * near_text.SAMPLES)  # all agree, so what meets is read
    copy = fresh(60)
    for i in range(70):
        # 68 and 69 share the first eight bands with all, and the last four with 17 others each; neither is a centre.
        side = 100 if i == 68 or 3 <= i < 20 else 200 if i == 69 or 20 <= i < 37 else 1000 + i
        bands = [k + 1 if k < 8 else side * 50 + k for k in range(n)]
        docs.append((i, " ".join(copy + ["end"] * (i == 69) if i > 67 else fresh(60))))
        reps.append((i, samples, bands, 180.0))
    docs = frame(spark, docs)
    reps = spark.createDataFrame(reps, "doc_id long, samples binary, bands array<long>, size double")
    links = near_text.near_links(docs, reps, near_text.document_weights(docs), near_text.SIMILARITY)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(68, 69)}


def test_near_duplicates_with_a_repeated_line(spark):
    """Copies with a line that repeats until it outweighs the text: alike without weights only."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for i in range(0, 48, 2):
        words = fresh(200)
        texts[i], texts[i + 1] = " ".join(words), " ".join(words + fresh(10) * 50)
    docs = frame(spark, list(texts.items()))
    got = {r["doc_id"]: r["class_id"] for r in near_text.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in texts}
