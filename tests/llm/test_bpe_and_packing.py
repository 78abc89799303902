import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditlake.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, piece int, length int"
TEXTS = [
    "", "  \n", "Hello,  wOrld's!", "İstanbul ΟΔΟΣ", "a" * 3000, "x<|endoftext|>Y <|startoftext|>",
    "a\x1cb\x85c d", "日本語 12½", "é ﬁ", "\U0001f600 ok", "don’t “q”", "<|x|>", "ab" * 700, "the cat " * 9000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_as_the_library(library):
    rng = random.Random(3)
    points = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0xA0, 0x250), lambda: rng.randrange(1, 0x3000)]
    texts = TEXTS + ["".join(chr(rng.choice(points)()) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    model = bpe.Bpe(PATH)
    for text, ids in zip(texts, model.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:50]
        assert model.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_trees_agree():
    rng = random.Random(4)
    model = bpe.Bpe(PATH)
    words = ["".join(rng.choice("abcdethéinou") for _ in range(rng.randrange(1, 40))).encode() for _ in range(2000)]
    assert model.encode_words(words) == [np.array(model._one(w), "<u4").tobytes() for w in words]


def test_round_trip(spark, library):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(None, None, None, None, None), (0, "", "x", 1, 1)]
    got = bpe.round_trip(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t, add_special_tokens=False).ids
        assert by[i]["n_tokens"] == len(ids)
        assert by[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def _optimum(lengths, capacity):
    best = len(lengths)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(lengths):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + lengths[i] <= capacity:
                go(i + 1, [*loads[:k], loads[k] + lengths[i], *loads[k + 1 :]])
        go(i + 1, [*loads, lengths[i]])

    go(0, [])
    return best


def test_bounds_never_pass_the_optimum():
    rng = np.random.default_rng(2)
    for _ in range(150):
        capacity = int(rng.choice([6, 10, 12, 30]))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 8))
        best = _optimum(sorted(lengths.tolist(), reverse=True), capacity)
        assert packing.lower_bound(lengths, capacity) <= best
        bins, offsets, fill = packing.best_fit_decreasing(lengths, capacity)
        assert fill.max() <= capacity and len(fill) >= best
    assert packing.lower_bound(np.full(9, 6), 10) == 9


def _check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_places_everything_once(spark, library):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(None, None, None, None, None), (0, "", "x", 1, 1)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, 4096).collect()
    _check(got, 4096)
    assert sum(1 for r in got if r["doc_id"] == 0) == 2 and sum(1 for r in got if r["doc_id"] is None) == 1
    for i, t in enumerate(TEXTS[1:], 1):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        want = [(k, a, min(4096, len(ids) - a), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert mine == want
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_exchange_between_buckets(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1400, 3000)
    pieces = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "row_no long, piece int, length long")
    got = packing.pack_pieces(pieces, 4096, bucket_pieces=200).collect()
    assert sorted(r["row_no"] for r in got) == list(range(3000))
    assert _check(got, 4096) <= packing.lower_bound(lengths, 4096) + 1
