"""Packing against the tokenizer on whole texts, and plans against counts of single pieces."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from govgraph.llm import packing
from govgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def expected_pieces(tokenizer, docs, size=4096):
    out = []
    for doc_id, text in docs:
        ids = ids_of(tokenizer, text)
        for n, k in enumerate(range(0, len(ids), size)):
            part = np.array(ids[k : k + size], dtype="<u4").tobytes()
            out.append((doc_id, n, k, len(part) // 4, zlib.crc32(part)))
    return Counter(out)


def assert_packed(rows, size=4096):
    """Every sequence is gapless from 0 and holds at most ``size``."""
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(placed)


def test_encoder_equals_the_tokenizer(tokenizer):
    encoder = packing.Encoder(PATH)
    letters = [chr(i) for i in range(0x21, 0x2B0)]
    texts = ["", " ", "\x1c x\x1cy", "Don't. STOP!.. a.b.'s 1.2, é. İ. ß. ǅ!", "<|endoftext|> x", "中文。文, Ω Σς", "".join(letters)]
    texts += [f"{a}." for a in letters] + [f"x{a} {a}x." for a in letters] + ["a" * 5_000, "word     next　last"]
    rng = random.Random(5)
    alphabet = "abcDEéÉßşĞ .,;:!?'\"\n\t09_-́ 漢İ🙂"
    texts += ["".join(rng.choices(alphabet, k=200)) for _ in range(300)]
    for text in texts:
        assert encoder.encode(text) == np.array(ids_of(tokenizer, text)[:-1], dtype="<u4").tobytes(), text


def test_stretches_and_forgetting_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 40)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    text = " ".join(f"word{i % 37} Épée, {i}." for i in range(300)) + " " + "x" * 500
    assert packing.Encoder(PATH).encode(text) == np.array(ids_of(tokenizer, text)[:-1], dtype="<u4").tobytes()


def best_fit(counts, size):
    """Best fit of single pieces, longest first: how many sequences it takes."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(left, i) for i, left in enumerate(room) if left >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(size - length)
    return len(room)


def test_plan_is_best_fit_on_single_pieces():
    rng = random.Random(11)
    for _ in range(60):
        size = rng.choice([10, 64, 100])
        counts = {rng.randint(1, size): rng.randint(1, 25) for _ in range(rng.randint(1, 20))}
        steps = packing.plan(counts, size)
        slots, ranks = defaultdict(list), defaultdict(list)
        for length, first, n, each, sequence, offset in steps:
            for k in range(n):
                slots[sequence + k // each].append((offset + k % each * length, length))
                ranks[length].append(first + k)
        assert {length: sorted(r) for length, r in ranks.items()} == {length: list(range(n)) for length, n in counts.items()}
        for parts in slots.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == best_fit(counts, size)


def test_plan_does_not_grow_with_the_number_of_documents():
    counts = {length: 1 + (length * 7919) % 50 for length in range(1, 4097)}
    small = packing.plan(counts)
    large = packing.plan({length: n * 10**9 for length, n in counts.items()})
    assert len(large) < 12 * 4096 and len(small) < 12 * 4096
    total = sum(length * n for length, n in counts.items()) * 10**9
    used = max(s[4] + (s[2] - 1) // s[3] for s in large) + 1
    assert used <= 1.001 * total / 4096 + 1


def test_whole_table(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op11_pack_documents"](spark, SF).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == expected_pieces(tokenizer, docs)
    total = sum(r["length"] for r in rows)
    assert assert_packed(rows) <= -(-total // 4096) + 1


def test_odd_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "ROW_BITS", 2)
    monkeypatch.setattr(packing, "RANK_BITS", 1)
    docs = [(None, None), (None, "a b"), (1, ""), (1, ""), (1, "other text"), (2, "x " * 9_000), (3, "word " * 4_095), (4, "\n")]
    docs += [(5, "the same text")] * 40
    frame = spark.createDataFrame([(a, b, "s", 0, 0) for a, b in docs], "doc_id long, text string, length string, _row int, piece int")
    rows = packing.pack(frame, ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected_pieces(tokenizer, docs)
    assert_packed(rows)
    whole = packing.sequences(packing.pack(frame, ids=True)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(len(ids_of(tokenizer, t)) for _, t in docs)
    for r in whole:
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 4096
        by_id = {(d["doc_id"], d["piece"]): d["offset"] for d in r["documents"]}
        if (4, 0) in by_id:
            assert r["ids"][4 * by_id[(4, 0)] :][:4] == (1).to_bytes(4, "little")
    assert sorted(len(r["documents"]) for r in whole)[-1] >= 40


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert packing.pack(empty).collect() == []
    one = packing.pack(spark.createDataFrame([("k", "one")], "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["length"], r["offset"]) for r in one] == [("k", 2, 0)]
