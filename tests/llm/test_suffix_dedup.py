import random

import pytest

from auditlake.llm import suffix_dedup

SCHEMA = "doc_id long, text string, kept string, n_spans int, key string"


def brute(rows, least):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for r in raws:
        for i in range(len(r) - least + 1):
            seen[r[i : i + least]] = seen.get(r[i : i + least], 0) + 1
    out = []
    for (d, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = b"\x01" * least
        runs = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, bytes(b for b, g in zip(r, gone) if not g), len(r), sum(gone), runs))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage = text(90)
    rows = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.3 and rows:
            x = rng.choice(rows)[1]
            at = rng.randrange(len(x) + 1)
            x = x[:at] + text(rng.randrange(3)) + x[at + rng.randrange(3) :]
        elif kind < 0.6:
            a, b = sorted(rng.sample(range(91), 2)) if rng.random() < 0.4 else (0, 90)
            x = text(rng.randrange(60)) + passage[a:b] + text(rng.randrange(60))
        elif kind < 0.7:
            x = rng.choice(["ab", "a", "xyz"]) * rng.randrange(100) + text(rng.randrange(50))
        else:
            x = text(rng.randrange(300))
        rows.append((i, x))
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (None, None), (900, ""), (901, "a" * 39), (902, "q" * 41)]


@pytest.mark.parametrize(("seed", "most"), [(1, 20_000), (2, 20_000), (3, 5), (4, 0)])
def test_as_brute_force(spark, seed, most):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1, "k") for d, t in rows], SCHEMA).repartition(4)
    got = suffix_dedup.suffix_dedup(docs, 40, most, gram=8).select("doc_id", "kept", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(((r[0], bytes(r[1]), *r[2:]) for r in got), key=repr) == brute(rows, 40)


def test_maximal_repeats_have_all_occurrences():
    lefts, rights = [b"..xyz", b"--xyz", b"==xyz", b"??abc"], [b"KEY1234.", b"KEY1234-", b"KEY12=", b"KEY1234."]
    got = {(m, left, right) for _, m, left, right in suffix_dedup.maximal_repeats(lefts, rights, 8)}
    assert got == {(0, 3, 7), (1, 3, 7), (0, 3, 5), (1, 3, 5), (2, 3, 5), (0, 0, 8), (3, 0, 8)}


def test_long_text_and_nothing(spark):
    rng = random.Random(9)
    half = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    docs = spark.createDataFrame([(1, half + "|" + half, "", 0, "")], SCHEMA)
    r = suffix_dedup.suffix_dedup(docs).first()
    assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == (600_000, 2, b"|")
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def by_words(rows, words):
    """The byte spans of each text that strings of so many words cover which another place has too."""
    import re

    seen, spans = {}, []
    for n, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        for k in range(len(at) - words + 1):
            a, b = at[k][0], at[k + words - 1][1]
            seen.setdefault(raw[a:b], []).append((n, a, b))
    for found in seen.values():
        if len(found) > 1:
            spans += found
    out = [bytearray(len((t or "").encode())) for _, t in rows]
    for n, a, b in spans:
        out[n][a:b] = b"\x01" * (b - a)
    return out


def brute_text(rows, least, words):
    """(id, what is left as text, removed bytes) under both rules."""
    marks = by_words(rows, words)
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for r in raws:
        for i in range(len(r) - least + 1):
            seen[r[i : i + least]] = seen.get(r[i : i + least], 0) + 1
    out = []
    for (d, _), r, gone in zip(rows, raws, marks):
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = b"\x01" * least
        out.append((d, bytes(b for b, g in zip(r, gone) if not g).decode("utf-8", "ignore"), sum(gone)))
    return sorted(out, key=repr)


def word_corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice(["an ", "dé ", "of\n", "the  ", "x\t", "moon ", "über "]) for _ in range(n))
    passage = prose(30)
    rows = []
    for i in range(120):
        kind = rng.random()
        if kind < 0.4:
            a, b = sorted(rng.sample(range(len(passage)), 2))
            x = prose(rng.randrange(20)) + (passage if rng.random() < 0.5 else passage[a:b]) + prose(rng.randrange(20))
        elif kind < 0.6 and rows:
            x = rng.choice(rows)[1]
            at = rng.randrange(len(x) + 1)
            x = x[:at] + prose(rng.randrange(2)) + x[at + rng.randrange(3) :]
        else:
            x = prose(rng.randrange(60))
        rows.append((i, x))
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (None, None), (900, ""), (901, "a a " * 40)]


@pytest.mark.parametrize(("seed", "most"), [(1, 2_000), (2, 3), (3, 0)])
def test_words_as_brute_force(spark, seed, most):
    rows = word_corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 1, "k") for d, t in rows], SCHEMA).repartition(4)
    got = suffix_dedup.suffix_dedup(docs, 60, most, gram=8, words=15)
    got = got.select("doc_id", "kept_text", "n_text_removed", "kept", "n_bytes", "n_removed", "n_spans", "n_kept_chars").collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == brute_text(rows, 60, 15)
    assert sorted(((r[0], bytes(r[3]), *r[4:7]) for r in got), key=repr) == brute(rows, 60)
    assert all(r["n_kept_chars"] == len(r["kept_text"]) for r in got)


@pytest.mark.parametrize("most", [2_000, 2])
def test_groups_have_all_occurrences(spark, most):
    """Every occurrence of a string that repeats lies in one group with all the others; groups' members are equal where they all agree."""
    rows = [(i, t) for i, t in corpus(5)[:60]]
    docs = spark.createDataFrame([(d, t, "x", 1, "k") for d, t in rows], SCHEMA)
    found = suffix_dedup.repeat_groups(docs, suffix_dedup.Bytes(40, 8), most).collect()
    raw = {d: t.encode() for d, t in rows}
    groups = {}
    for r in found:
        groups.setdefault((r["gram"], r["repeat"], raw[r["doc_id"]][r["start"] : r["stop"]] if r["repeat"] is None else None), set()).add((r["doc_id"], r["start"], r["stop"]))
    places = {}
    for d, t in raw.items():
        for i in range(len(t) - 39):
            places.setdefault(t[i : i + 40], set()).add((d, i))
    spans = {key: {(d, i) for d, a, b in members for i in range(a, b - 39)} for key, members in groups.items()}
    for text, where in places.items():
        if len(where) > 1:
            assert any(where <= held for held in spans.values()), text
    covered = set().union(*spans.values()) if spans else set()
    assert covered == {x for where in places.values() if len(where) > 1 for x in where}


def test_more_suffixes_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "KEYS_SENT", 0)
    rows = corpus(6)[:90]
    docs = spark.createDataFrame([(d, t, "x", 1, "k") for d, t in rows], SCHEMA)
    got = suffix_dedup.suffix_dedup(docs, 40, gram=8).select("doc_id", "kept", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(((r[0], bytes(r[1]), *r[2:]) for r in got), key=repr) == brute(rows, 40)


def test_equal_rows_give_their_contexts_once(spark):
    """However often a row is repeated, what goes on to the trees is that of one row; the spans are those of all."""
    rows = corpus(7)[:7]
    docs = [(d, t, "x", 1, "k") for d, t in rows] + [(None, rows[0][1], "x", 1, "k")] * 3000 + [(3, rows[1][1], "x", 1, "k")] * 50
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    _, source = suffix_dedup._keyed(df, "doc_id", "text")
    scratch = suffix_dedup.Scratch(spark)
    assert suffix_dedup.each_once(source, scratch).count() == source.select("key", "doc_id").distinct().count() <= 9
    assert suffix_dedup.each_once(source.filter("doc_id IS NOT NULL AND doc_id <> 3"), scratch).count() == source.filter("doc_id IS NOT NULL AND doc_id <> 3").count()
    few = docs[:7] + [docs[7]] * 2 + [docs[-1]] * 2
    got = {(r["doc_id"], r["text"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(df, 40, gram=8).select("doc_id", "text", "kept").collect()}
    want = {(r["doc_id"], r["text"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(few, SCHEMA), 40, gram=8).select("doc_id", "text", "kept").collect()}
    assert got == want
