import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline
import test_line_dedup
import test_ngram_join
import test_suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def _texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS) and df.filter("n_chars <> length(text)").count() == 0


def test_classifier_keeps_clean_documents(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in _texts(steps[1])}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i not in kept for i in bad) >= 0.9 * len(bad)


def test_stages_as_brute_force(steps):
    lines = test_line_dedup.brute(_texts(steps[1]))
    assert _texts(steps[2]) == sorted((i, t) for i, t, *_ in lines)
    before = _texts(steps[2])
    stay = {d for d, _, c in test_ngram_join.brute(before) if d == c}
    assert _texts(steps[3]) == [x for x in before if x[0] in stay]
    cut = test_suffix_dedup.brute_text(_texts(steps[3]), 400, 51)
    assert _texts(steps[4]) == sorted((d, kept) for d, kept, _ in cut)


def test_packing_holds_every_document(steps):
    assert {r["doc_id"] for r in steps[5].select("doc_id").collect()} == {i for i, _ in _texts(steps[4])}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_copies_without_id_or_with_the_same_id_leave_one_row(spark):
    words = lambda a: " ".join(f"word{k}" for k in range(a, a + 90))
    rows = [(1, words(0)), (1, words(0)), (None, words(0)), (2, words(100)), (None, words(100)), (None, words(200)), (None, words(200)), (3, words(300)), (4, words(300)), (4, words(400)), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_repeats(spark, corpus_pipeline.drop_near_copies(spark, docs, SF), SF)
    left = sorted(((r["doc_id"], r["text"]) for r in kept.filter("n_chars > 0").collect()), key=repr)
    assert left == sorted([(1, words(0)), (2, words(100)), (None, words(200)), (3, words(300)), (4, words(400))], key=repr)
    assert kept.filter("n_chars = 0").count() == 2


def test_passages_of_over_fifty_words_go(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    fifty, more, tiny, twice = words("x", 50), words("y", 51), " ".join("ab"[k % 3 == 0] for k in range(60)), words("z", 55)
    assert max(map(len, (fifty, more, tiny, twice))) < 400
    texts = [f"{words('p', 90)} {fifty} {words('q', 9)} {more}", f"{more} {words('r', 90)} {fifty}", f"{tiny} {words('s', 30)}", f"{words('t', 30)} {tiny}", f"{twice} {words('u', 5)} {twice}"]
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, None, "en", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeats(spark, docs, SF).collect()}
    want = [f"{words('p', 90)} {fifty} {words('q', 9)} ", f" {words('r', 90)} {fifty}", f" {words('s', 30)}", f"{words('t', 30)} ", f" {words('u', 5)} "]
    assert kept == {**dict(enumerate(want)), None: ""}


def test_edges_through_all_stages(spark):
    """Null, empty, very long and repeated rows, and columns that clash, pass every stage; an empty table stays empty."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    first = docs.first()
    odd = [
        (None, None, None, None, None), (None, "", "en", "web", 0), (None, first["text"], "en", "web", 5), (first["doc_id"], first["text"], first["lang"], first["source"], first["n_chars"]),
        (900_001, "word " * 60_000, "en", "web", 0), (900_002, " \n\n ", None, None, None),
    ]
    rows = docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = rows.withColumn("kept", F.lit(1)).withColumn("score", F.lit("x")).withColumn("n_lines", F.lit(2))
    none = rows.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows, none = corpus_pipeline.written(stage(spark, rows, SF), f"edge-{k}"), stage(spark, none, SF)
        if k < 4:
            assert rows.columns == none.columns == list(corpus_pipeline.COLUMNS)
        assert none.count() == 0
        none = corpus_pipeline.written(none, f"none-{k}")
    assert rows.count() > 0
