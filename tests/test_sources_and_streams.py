"""Sources, sinks and streaming jobs on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from auditlake.sources import io
from auditlake.streaming import jobs
from auditlake.streaming.versions import KeysOnce, LatestStatus


def _lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_json_lines(spark, tmp_path):
    path = _lines(tmp_path / "in" / "a.jsonl", [{"a": 1}, "", "{bad", {"a": 2}])
    assert io.jsonl_lenient(spark, path, "a int").filter("a IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        io.jsonl_strict(spark, path, "a int").collect()
    counted = io.jsonl_counted(spark, path, spark.createDataFrame([], "a int").schema).cache()
    assert tuple(io.malformed(counted).first()) == (2, 1)
    assert io.variant_lines(spark, path).filter("v IS NULL").count() == 1
    nested = _lines(tmp_path / "n.jsonl", [{"o": {"p": "x"}}, {"o": 3}])
    assert [r[0] for r in io.variant_lines(spark, nested).select(io.at_path("v", "o.p")).collect()] == ["x", None]
    assert io.jsonl_directory(spark, str(tmp_path / "in"), "a int").select("file").distinct().first()[0] == "a.jsonl"


def test_documents_and_states(spark, tmp_path):
    assert io.json_document(spark, str(tmp_path / "no.json"), "a int").count() == 0
    good = _lines(tmp_path / "g.json", ['{"a": 1}'])
    assert io.json_document(spark, good, "a int").first()["a"] == 1
    assert io.baseline_state(spark, good, True) == "AVAILABLE" and io.baseline_state(spark, None, False) == "FIRST_RUN"
    assert io.baseline_state(spark, str(tmp_path / "x"), True) == "BASELINE_MISSING"
    assert io.baseline_state(spark, _lines(tmp_path / "b.json", ["{"]), True) == "BASELINE_CORRUPTED"


def test_csv_and_digests(spark, tmp_path):
    (tmp_path / "s.csv").write_text('code,language,safety\n"int a;\nint b;",C/cpp,x\n,c,y\n"z",python,\n')
    rows = io.csv_rows(spark, str(tmp_path / "s.csv"), "code string, language string, safety string")
    assert [r["code"] for r in io.snippets(rows, "c").collect()] == ["int a;\nint b;"]
    assert io.csv_rows(spark, str(tmp_path / "none.csv"), "code string").count() == 0
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    declared = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest()), ("b.bin", "0"), ("../c", "0")], "name string, sha256 string")
    states = {r["name"]: r["state"] for r in io.verified_manifest(declared, io.digests(spark, str(tmp_path / "m"))).collect()}
    assert states == {"a.bin": "ok", "b.bin": "missing", "../c": "outside"}


def test_paths(tmp_path):
    assert io.checked_path("a/b.json", str(tmp_path), frozenset({".json"})).endswith("a/b.json")
    for bad in ("../x.json", "x.txt"):
        with pytest.raises(io.PathError):
            io.checked_path(bad, str(tmp_path), frozenset({".json"}))


def test_seed_contract(spark):
    info = {"predicate": "p", "evidence_hooks": ["h"], "uncertainty": "u", "proof_requirements": "r"}
    good = {"line": 1, "topic": "x" * 300, "predicate": "p", "language": "C", "anchors": ["a"], "gepa_info": info}
    schema = "line int, topic string, predicate string, language string, anchors array<string>, gepa_info struct<predicate:string,evidence_hooks:array<string>,uncertainty:string,proof_requirements:string>"
    check = lambda rows, n: tuple(io.corpus_check(spark.createDataFrame(rows, schema), "line", n).first())
    assert check([good], 1) == (1, None, True) and check([good], 2)[2] is False
    assert check([good | {"line": 2, "language": "go"}, good | {"topic": "short"}], 2)[1] == "topic length"


def test_checkpoint_and_store(spark, tmp_path):
    io.checkpoint(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "c"), 2, "2024-01-01")
    assert io.load_checkpoint(spark, str(tmp_path / "c"), 2).count() == 1
    with pytest.raises(Exception):
        io.load_checkpoint(spark, str(tmp_path / "c"), 3).collect()
    store = spark.createDataFrame([("h", "r")], "hash string, response string")
    asked = spark.createDataFrame([("h",), ("m",)], "hash string")
    assert {r["hash"]: r["response"] for r in io.cached_answers(asked, store).collect()} == {"h": "r", "m": None}
    with pytest.raises(Exception):
        io.cached_answers(asked, store, replay=True).collect()
    assert io.record_answers(spark.createDataFrame([("h", "r"), ("n", "q"), ("n", "q")], "hash string, response string"), store).count() == 1
    assert io.synthetic_floor(spark.range(2), spark.range(8)).count() == 10 and io.synthetic_floor(spark.range(4), spark.range(8)).count() == 4
    assert "| a\\|b |" in io.markdown("t", spark.createDataFrame([("a|b",)], "x string"))


def test_streams(spark, tmp_path):
    rows = [{"id": i, "k": "ab"[i % 2], "name": f"n{i % 3}", "ok": i % 4 != 0, "tokens": 5, "ts": f"2024-01-01T{i:02d}:00:00Z"} for i in range(12)]
    _lines(tmp_path / "in" / "1.json", rows[:6])
    _lines(tmp_path / "in" / "2.json", rows[6:])
    schema = "id int, k string, name string, ok boolean, tokens long, ts timestamp"
    tail = lambda: jobs.tailed(spark, str(tmp_path / "in"), schema, 1)

    jobs.started(jobs.accepted_once(tail(), "k", "name", "ok"), "once", str(tmp_path / "c1")).awaitTermination(90)
    seen, want = {}, 0
    for r in rows:
        want += r["name"] in seen.setdefault(r["k"], set())
        if r["ok"]:
            seen[r["k"]].add(r["name"])
    assert spark.table("once").filter("duplicate").count() == want

    jobs.started(jobs.stop_rule_state(tail(), "k", 100, 4, 1000, 3, 0.0), "stops", str(tmp_path / "c2"), "update").awaitTermination(90)
    assert spark.table("stops").agg(F.max("calls")).first()[0] == 4

    query = tail().writeStream.foreachBatch(KeysOnce(spark, str(tmp_path / "out"), "name")).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3

    query = tail().writeStream.foreachBatch(LatestStatus(spark, str(tmp_path / "status"), "name", "id")).option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert {r["id"] for r in LatestStatus(spark, str(tmp_path / "status"), "name", "id").statuses().collect()} == {9, 10, 11}

    jobs.started(jobs.stage_windows(tail(), "ts", "k", "tokens"), "windows", str(tmp_path / "c5")).awaitTermination(90)
    assert spark.table("windows").count() >= 5


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n' + "".join(f'{{"a": {k}}}\n' for k in range(500)))
    got = io.numbered_lines(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()
    assert [r["line"] for r in got] == list(range(1, 504)) and got[2]["value"] == '{"a": 2}'
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # several blocks a file
    try:
        cut = io.numbered_lines(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line"], r["value"]) for r in cut] == [(r["line"], r["value"]) for r in got]
    assert io.jsonl_strict_numbered(spark, str(tmp_path / "a.jsonl")).count() == 502
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nbad\n')
    with pytest.raises(Exception, match="Invalid JSON on line 2"):
        io.jsonl_strict_numbered(spark, str(tmp_path / "b.jsonl")).collect()


def test_replacements_survive_a_break(spark, tmp_path):
    path = str(tmp_path / "state")
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    io.checkpoint(one, path, 1, "2024-01-01")
    io.checkpoint(two, path, 1, "2024-01-02")
    assert io.load_checkpoint(spark, path, 1).first()["a"] == 2
    (tmp_path / "state").rename(tmp_path / "state.old")  # broken off between the two renames
    assert io.load_checkpoint(spark, path, 1).first()["a"] == 2

    bad = one.select(F.raise_error(F.lit("broken")).cast("int").alias("a"))
    with pytest.raises(Exception, match="broken"):
        io.checkpoint(bad, path, 1, "2024-01-03")
    assert io.load_checkpoint(spark, path, 1).first()["a"] == 2
    io.replace_json(one, str(tmp_path / "doc"))
    io.replace_json(two, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).first()["a"] == 2


def test_markdown_shows_all_rows_or_says_what_it_leaves_out(spark):
    rows = spark.range(1500)
    assert io.markdown("t", rows).count("\n| ") == 1502  # with its two head lines
    assert io.markdown("t", rows, most=3).endswith("1497 rows more\n")


def test_logs_spans_and_manifests(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 0.5)], "a int, c double")
    assert [tuple(r) for r in io.union_logs(a, b).orderBy("a").collect()] == [(1, "x", None), (2, None, 0.5)]

    assert io.export_spans(a, str(tmp_path / "spans")) and io.export_spans(a, str(tmp_path / "spans"))
    assert spark.read.json(str(tmp_path / "spans")).count() == 2
    assert not io.export_spans(a.select(F.raise_error(F.lit("no")).cast("int").alias("a")), str(tmp_path / "spans"))
    (tmp_path / "taken").write_text("a file")
    assert not io.export_spans(a, str(tmp_path / "taken"))

    io.start_expansion(a, str(tmp_path / "seeds"))
    io.append_jsonl(a.withColumn("a", F.lit(9)), str(tmp_path / "seeds"))
    assert sorted(r["a"] for r in spark.read.json(str(tmp_path / "seeds")).collect()) == [1, 9]

    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "w.bin").write_bytes(b"abc")
    io.write_manifest(spark, str(tmp_path / "model"), str(tmp_path / "manifest"), {"sample_count": 3, "kind": "gbt"})
    got = spark.read.json(str(tmp_path / "manifest")).first()
    assert (got["sample_count"], got["kind"]) == (3, "gbt") and [(x["name"], x["size"]) for x in got["artifacts"]] == [("w.bin", 3)]
    declared = spark.createDataFrame([("w.bin", got["artifacts"][0]["sha256"]), ("gone", "0")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in io.verified_manifest(declared, io.digests(spark, str(tmp_path / "model"))).collect()} == {"w.bin": "ok", "gone": "missing"}
