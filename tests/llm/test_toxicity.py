import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import toxicity as T

SF = "/root/testdata/sf0.01"
G = T.Grammar(T.lexicon())


def clauses(text):
    """A plain reading, word by word and rule by rule: what each clause that matches holds."""
    out, quoted = [], False
    exact = {w: s for s, t in T.WORDS.items() for w in t.split() if not w.endswith("*")}
    stems = sorted(((w[:-1], s) for s, t in T.WORDS.items() for w in t.split() if w.endswith("*")), key=lambda x: len(x[0]))
    number = 0
    clause = {"listed": 0, "soft": 0, "threat": 0, "target": 0, "negated": False, "reported": False, "intent": False, "last": None}

    def close(line):
        nonlocal clause, quoted
        if clause["listed"] or clause["soft"] or clause["threat"]:
            out.append((min(clause["listed"], 2), 0, min(clause["soft"], 1), clause["threat"], min(clause["target"], 1)))
        clause = {"listed": 0, "soft": 0, "threat": 0, "target": 0, "negated": False, "reported": False, "intent": False, "last": None}
        if line:
            quoted = False

    for m in re.finditer(r"[a-z0-9'À-῿]+|[.!?;]|\n|[\"“”„«»]", text.lower()):
        word = m.group()
        if word in ".!?;":
            close(False)
        elif word == "\n":
            close(True)
        elif word in "\"“”„«»":
            quoted = not quoted
            clause["last"] = None
        else:
            number += 1
            symbol = exact.get(word)
            if symbol is None:
                for stem, s in stems:
                    if word.startswith(stem):
                        symbol = s
            if symbol is None:
                continue
            if clause["last"] is not None and number - clause["last"] > T.REACH:
                clause["negated"] = clause["intent"] = False
            clause["last"] = number
            if symbol == T.NEGATION:
                clause["negated"] = True
            elif symbol == T.CONTRAST:
                clause["negated"] = False
            elif symbol == T.REPORT:
                clause["reported"] = True
            elif symbol == T.TARGET:
                clause["target"] += 1
            elif symbol == T.INTENT:
                clause["intent"] = True
            elif quoted or clause["reported"] or clause["negated"]:
                clause["soft"] += 1
            elif symbol == T.LISTED:
                clause["listed"] += 1
            elif clause["intent"]:
                clause["threat"] = 1
    close(True)
    return out


def run_on(text, grammar=G):
    r = T.read(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    at, before, symbols = T.events(r, grammar.lex)
    symbols, _, lengths = T._streams(at, before, symbols, np.zeros(len(at), np.int64), 1)
    put = T.run_machine(grammar.steps, grammar.outs, symbols, lengths)
    return [grammar.patterns[k] for k in put[put >= 0] if any(grammar.patterns[k][:4])]


def test_clauses_and_not_words():
    assert run_on("You are an IDIOT.") == [(1, 0, 0, 0, 1)]
    assert run_on("You are not an idiot or a moron.") == [(0, 0, 1, 0, 1)]
    assert run_on("You are not clever but an idiot.") == [(1, 0, 0, 0, 1)]
    assert run_on('The word "idiot" is Greek.') == [(0, 0, 1, 0, 0)]
    assert run_on("He was called an idiot; you idiot, you moron!") == [(0, 0, 1, 0, 1), (2, 0, 0, 0, 1)]
    assert run_on("I'll kill you") == [(0, 0, 0, 1, 1)]
    assert run_on("We kill the process.") == [] and run_on("We will never kill it") == [(0, 0, 1, 0, 0)]
    assert run_on("Not one of all those words that stand in between is idiot") == [(1, 0, 0, 0, 1)]


WORDS = ["you", "IDIOT", "idiots,", "moron", "not", "never", "but", "said", "will", "kill", "Débile", "é", "word", "a", ".", "!", "\n", '"', "“", "»", "x.y", "don't", "trash"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=60))
def test_machine_equals_plain_rules(words):
    text = " ".join(words)
    assert run_on(text) == clauses(text)


def test_long_texts_in_chunks(monkeypatch):
    text = ("plain words, and you idiot said \"trash\" not a moron.\n" * 40 + "ü" * 300 + " ") * 3
    whole = G.features(pa.array([text, "idiot", None, ""]))
    monkeypatch.setattr(T, "CHUNK", 1000)
    assert np.allclose(G.features(pa.array([text, "idiot", None, ""])), whole)
    assert whole[0, 0] > 4 and not whole[2:].any()
    data = np.frombuffer(("é" * 5000).encode(), np.uint8)
    parts = list(T.chunks(data, 0, len(data), 1000))
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    for a, b in parts:
        data[a:b].tobytes().decode()


def test_composition_by_hand():
    double = T.Transducer(0, lambda q, s: (q + 1 if q < 3 else 3, s) if s == T.LISTED else None)
    only = T.compose(double, T.beside(T.counter(T.LISTED, 2)))
    steps, outs, made = T.tables(only)
    put = T.run_machine(steps, outs, np.array([T.LISTED, T.LISTED, T.LISTED, T.END, T.LISTED, T.LINE], np.int8), np.array([4, 2]))
    assert [made[k] for k in put[put >= 0]] == [(2,), (1,)]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in T.score(docs.select("doc_id", "text"), labels).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    out = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(s >= T.THRESHOLD) == bool(y) for s, y in out]) >= 0.95
    assert not [1 for s, y in out if s >= T.THRESHOLD and not y]


def test_roots_are_learned_but_not_from_copies(spark):
    """An invented root marks toxic texts; words that copies of one toxic text share do not become roots."""
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        words = list(rng.choice(plain, 40))
        toxic = k % 5 == 0
        if toxic:
            words[3], words[9] = "zorgul" + plain[k % 300][:2], "zorgul" + plain[(k + 1) % 300][:3]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    copy = "qwertz " + " ".join(plain[:30]) + " zorgulxx zorgulyy"
    rows += [(k, copy) for k in range(400, 460)]
    labels += [(k, 1) for k in range(400, 460)]
    marked = spark.createDataFrame([(label, text) for (_, text), (_, label) in zip(rows, labels)], "label int, text string")
    roots = {h for h, _, _ in T.learn_roots(marked)}
    assert int(T.hash_of("zorgul")) in roots
    assert not roots & {int(T.hash_of("qwertz"[:n])) for n in range(3, 7)}
    found = T.score(spark.createDataFrame([*rows, (900, "new zorgulqq and zorgulrr"), (901, "new words and words")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    by = {r["doc_id"]: r["score"] for r in found.filter("doc_id >= 900").collect()}
    assert by[900] >= 0.5 > by[901]


def test_edges(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "you idiot", None, None), (1, "idiot " * 300_000, "x", 0), (3, "fine words", "x", 0), (3, "fine words", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    got = T.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    by = {r["text"]: r["score"] for r in T.score(docs, none).collect()}
    assert by["you idiot"] > by["fine words"] == by[""] == by[None]
    assert T.score(docs.limit(0), none).count() == 0 and T.score(docs.limit(0), none).columns == ["doc_id", "text", "toxic", "score"]
