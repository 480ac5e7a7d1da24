"""Word hashes, shingles and components against plain versions."""

import random

from govgraph.llm.common import components, shingle_hashes, word_hashes


def test_equal_words_have_equal_hashes_wherever_they_stand():
    text = "The cat, the CAT; sat on 42 mats. été ÉTÉ " + "x " * 70_000 + "cat"
    got = word_hashes(text)
    assert got[0] == got[2] and got[1] == got[3] == got[-1] and got[8] == got[9]
    assert len(got) == 10 + 70_000 + 1
    assert len(set(got.tolist())) == len({"the", "cat", "sat", "on", "42", "mats", "été", "x"})


def test_no_words():
    assert len(word_hashes(None)) == len(word_hashes("")) == len(word_hashes("?! \n")) == 0
    assert len(shingle_hashes(word_hashes(""), 5)) == 0


def test_short_text_is_one_shingle():
    assert len(shingle_hashes(word_hashes("one two"), 5)) == 1
    assert len(shingle_hashes(word_hashes("a b c d e f"), 5)) == 2
    assert shingle_hashes(word_hashes("a b c d e"), 5)[0] == shingle_hashes(word_hashes("A  b, c d e f"), 5)[0]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    edges += [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    expected = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: c for x, c in expected.items() if x in {r["node"] for r in got}}
    assert {x for x in expected if any(x in e and e[0] != e[1] for e in edges)} == {r["node"] for r in got}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
