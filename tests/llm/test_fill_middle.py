import hashlib

import duckdb
import regex

from auditlake.llm import fill_middle, queries

SF = "/root/testdata/sf0.01"


def brute(key, text):
    digits = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b])
    return (n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b])


def test_edges(spark):
    texts = [None, "", "x", "<P>", "a<S>b", "<M", "<<<<<", "P>S>M>", "é́👨‍👩‍👧\n\r\n  \x00", "long " * 200_000, "<" * 50 + "P" * 9 + ">" * 50]
    rows = [(k, t, "n", "f", "o") for k in [*range(40), 10**12, -5, None] for t in texts] + [(7, "x", "n", "f", "o")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, form string, source string").repartition(4)
    out = fill_middle.fill_middle(df)
    assert out.columns == ["doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    got = out.collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = r["text"] or ""
        want = brute("" if r["doc_id"] is None else r["doc_id"], text)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["output_sha256"] == hashlib.sha256(want[4].encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert fill_middle.fill_middle(df.limit(0)).collect() == []


def test_other_units():
    words = regex.compile(r"\S+")
    for key in range(60):
        text = " one two,\n three  "
        n, form, prefix, middle, output = fill_middle.transform(text, f"1:{key}", words)
        assert n == 3 and fill_middle.restore(output, form) == text
        if form != "plain":
            ends = [0, 4, 9, 16]
            assert prefix in ends and prefix + middle in ends


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_fill_in_middle"])
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall(), key=repr)
    df = queries.QUERIES["op12_fill_in_middle"](spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == want
