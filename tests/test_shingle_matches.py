"""Matches between two sides against all pairs."""

import random

from auditlake.operators import dedup


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_matches_of_two_sides(spark):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(15)]

    def changed(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "other"
        return " ".join(w)

    known = [(f"k{i}", t) for i, t in enumerate(base)] + [("dup", base[0]), ("none", ""), ("short", "a b")]
    rows = [(f"r{i}", changed(rng.choice(base), rng.randrange(3)) + rng.choice(["", " more words"])) for i in range(60)] + [("r-short", "a b"), ("r-none", ""), ("r-null", None)]
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in dedup.shingle_matches(spark.createDataFrame(rows, "id string, t string"), spark.createDataFrame(known, "id string, t string"), "id", "t", 0.6).collect()}
    first = lambda side: {t: min(i for i, u in side if u == t) for _, t in side if t is not None}
    want = {}
    for t, a in first(rows).items():
        for u, b in first(known).items():
            x, y = shingles(t), shingles(u)
            if x and y and len(x & y) / len(x | y) > 0.6:
                want[a, b] = round(len(x & y) / len(x | y), 9)
    assert got == want and len(want) > 20


def test_what_one_side_alone_repeats_makes_no_candidates(spark):
    rows = spark.range(3000).selectExpr("cast(id as string) as id", "concat('the same boilerplate text on every page here ', id) as t")
    known = spark.createDataFrame([("k", "nothing of that kind stands here at all")], "id string, t string")
    assert dedup.shingle_matches(rows, known, "id", "t").count() == 0


def test_sets_are_kept_of_candidates_only(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(80)]
    rows = [(k + 10, t) for k, t in enumerate(texts)] + [(5, texts[0] + " more"), (7, texts[1])]
    sizes, written = {}, dedup.written

    def counted(df, tag):
        out = written(df, tag)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(dedup, "written", counted)
    got = sorted((r["a"], r["b"]) for r in dedup.shingle_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect())
    assert got == [(5, 10)]
    assert sizes["shingle-sets"] == 2 and sizes["shingle-prefixes"] < 81 * 60 / 4


def test_tiers_are_kept_once_a_text_and_without_it(spark, monkeypatch):
    kept, written = {}, dedup.written

    def seen(df, tag):
        kept[tag] = written(df, tag)
        return kept[tag]

    monkeypatch.setattr(dedup, "written", seen)
    rows = spark.createDataFrame([(k, "a b c") for k in range(50)] + [(50, "A  b c"), (51, "else"), (52, None)], "id long, t string")
    known = spark.createDataFrame([("a b c",)], "t string")
    got = {r["id"]: r["tier"] for r in dedup.duplicate_tiers(rows, "id", "t", known, "t").collect()}
    assert got == {k: "exact" for k in range(50)} | {50: "normalized", 51: None, 52: None}
    assert kept["tiers"].count() == 4 and "t" not in kept["tiers"].columns
