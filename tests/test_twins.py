"""Queries against their SQL twins on tables that the small copies have no likes of."""

import datetime

import duckdb

from auditlake.plans import registry


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(found)
    return got


def test_edges_of_many_parts_keep_numbers_of_their_own(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    part = [(5, 0), (100005, 0)]
    lines = [(1, 100005, 1, 1, 45.0, day), (1, 5, 1, 2, 45.0, day), (2, 100005, 1, 3, 45.0, day), (2, 5, 1, 4, 45.0, day)]
    orders = [(1, day, 1, 1.0), (2, day, 1, 1.0)]
    tables = {
        "part": (part, "p_partkey long, p_size int"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp"),
        "orders": (orders, "o_orderkey long, o_orderdate timestamp, o_custkey long, o_totalprice double"),
    }
    got = same(spark, tmp_path, "graph_failure_bucket", **tables)
    assert got == [(1, "B_SANITIZER_TARGET_MISMATCH"), (2, "B_SANITIZER_MISMATCH")]
    assert {r[0]: r[3] for r in same(spark, tmp_path, "graph_proof_states", **tables)} == {"wrong_sanitizer": 2}


def test_folds_of_sources_alike_in_three_digits(spark, tmp_path):
    sizes = {"a": 1001, "b": 1009, "c": 1003, "d": 1007, "e": 1005, "f": 30, "g": 12}
    docs = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    tables = {"documents": (docs, "doc_id long, source string"), "labels": ([(k, int(s < "f")) for k, s in docs], "doc_id long, quality int")}
    assert len(same(spark, tmp_path, "stratified_folds", **tables)) == 35
