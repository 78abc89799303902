import zlib

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import quality

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, quality int, id string"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text"), labels).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    out = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(s >= quality.THRESHOLD) == bool(y) for s, y in out]) >= 0.97


def test_edges(spark):
    rows = [(1, None, "x", 1, "i"), (2, "", "x", 1, "i"), (None, "some words", None, None, None), (1, "again " * 200_000, "x", 0, "i"), (3, "ÉTÉ!! Été", "x", 0, "i")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.score(docs, spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")).collect()
    assert len(got) == 5 and all(0 < r["score"] < 1 for r in got)
    assert quality.score(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_pooling_as_word_by_word():
    texts = pa.array(["One two two THREE!!", None, "", "x | y. " * 3000, "été ÉTÉ"])
    vectors = np.random.default_rng(1).standard_normal((quality.CONTENT + quality.SHAPES, quality.DIM)).astype(np.float32)
    of, content, form = quality.tokens(texts)
    got = quality.pooled(texts, vectors)
    for k in range(len(texts)):
        mine = of == k
        if mine.any():
            assert got[k, : quality.DIM] == pytest.approx(vectors[content[mine]].mean(axis=0, dtype=np.float64), abs=1e-4)
            assert got[k, quality.DIM : 2 * quality.DIM] == pytest.approx(vectors[quality.CONTENT + form[mine]].mean(axis=0), abs=1e-4)
        else:
            assert not got[k].any()


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(int)
    s = quality.fit(x, y).scores(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        some = (s >= low) & (s < low + 0.2)
        assert abs(s[some].mean() - y[some].mean()) < 0.08


def test_word_vectors_as_word_by_word(spark):
    """A row's vector: the mean over its words' places of their index vectors and their neighbours', less the mean of all rows."""
    texts = ["one two three two", None, "", "Two ONE\tfour five six seven", "one"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    sums, counts = {}, {}
    for t in texts:
        _, hashes, _ = quality.words(pa.array([t]))
        own = quality.index_vectors(hashes).astype(int)
        for k, h in enumerate(hashes):
            row = int(h % np.uint64(quality.CONTENT))
            near = own[max(0, k - quality.SPAN) : k + quality.SPAN + 1].sum(axis=0)
            sums[row], counts[row] = sums.get(row, 0) + near, counts.get(row, 0) + 1
    mean = {row: sums[row] / counts[row] for row in sums}
    centre = np.mean(list(mean.values()), axis=0)
    assert got.shape == (quality.CONTENT + quality.SHAPES, quality.DIM)
    for row, vector in mean.items():
        assert got[row] == pytest.approx(vector - centre, abs=1e-5)
    assert np.abs(quality.index_vectors(np.arange(50, dtype=np.uint64))).sum(axis=1).max() <= quality.NONZERO
