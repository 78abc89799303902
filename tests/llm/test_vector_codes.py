import hashlib
import math

import duckdb
import numpy as np
import pytest

from auditlake.llm import queries, vector_codes

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, id int, size int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Python over (id, vector, label) rows in the operator's order."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    width = len(rows[0][1])
    bounds = vector_codes.part_bounds(width, parts)
    whole = [[int(x) * scale if abs(x) > 2**53 else math.floor(x * scale) for x in r[1]] for r in rows]
    books = [[v[a:b] for v in whole[:entries]] for a, b in bounds]

    def nearest(x, book):
        apart = [sum((p - q) ** 2 for p, q in zip(x, c)) for c in book]
        return apart.index(min(apart)), min(apart)

    for _ in range(rounds):
        for k, (a, b) in enumerate(bounds):
            met = {}
            for v in whole:
                met.setdefault(nearest(v[a:b], books[k])[0], []).append(v[a:b])
            books[k] = [[sum(c) // len(c) for c in zip(*met[e])] if e in met else old for e, old in enumerate(books[k])]
    out, per_label = [], {}
    for r, v in zip(rows, whole):
        found = [nearest(v[a:b], books[k]) for k, (a, b) in enumerate(bounds)]
        error = sum(d for _, d in found)
        per_label[r[2]] = per_label.get(r[2], 0) + error
        out.append([r[0], "".join(f"{e:02x}" for e, _ in found), error, r[2]])
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    small = lambda x: x if x < 2**63 else None
    return sorted(((i, c, small(e), small(per_label[label]), sha) for i, c, e, label in out), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", "y", 1, 2) for i, v, label in rows], SCHEMA).repartition(3)
    got = vector_codes.compress(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_edges(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((40, 10)).tolist()
    rows = [(k, v, k % 3 or None) for k, v in enumerate(vectors)]
    rows += [(3, vectors[5], 1), (3, vectors[5], 1), (None, vectors[7], None), (50, None, 1), (51, [None] * 10, 1), (52, [float("nan")] * 10, 1), (53, [float("inf")] * 10, 2), (54, [1.0], 1), (55, [], 1)]
    assert run(spark, rows, entries=6) == brute(rows, entries=6)
    assert run(spark, rows) == brute(rows)  # fewer rows than entries
    assert run(spark, rows[:1]) == brute(rows[:1])
    assert run(spark, []) == [] and run(spark, [(1, None, None)]) == []
    short = [(k, v[:3], 1) for k, v in enumerate(vectors)]  # fewer components than parts
    assert run(spark, short, entries=5, rounds=2) == brute(short, entries=5, rounds=2)
    ties = [(k, [float(k % 2)] * 4, 1) for k in range(30)]
    assert run(spark, ties, entries=4) == brute(ties, entries=4)


def test_components_of_any_size(spark):
    rows = [(k, [1e30 * (k % 7) - 3e30, -0.5 * k, 3e5 * k, 1e-9], k % 2) for k in range(30)]
    assert run(spark, rows, entries=5) == brute(rows, entries=5)


def test_distances_are_exact():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-(1 << 27), 1 << 27, (9000, 16)), rng.integers(-(1 << 27), 1 << 27, (200, 16))
    entry, apart = vector_codes.nearest_entries(x, c)
    some = rng.integers(0, 9000, 50)
    for k in some:
        full = [sum((int(p) - int(q)) ** 2 for p, q in zip(x[k], row)) for row in c]
        assert entry[k] == full.index(min(full)) and apart[k] == min(full)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_vector_codes"])
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall())
    df = queries.QUERIES["op11_vector_codes"](spark, SF)
    assert dict(df.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    assert sorted(tuple(r) for r in df.select(*names).collect()) == want and len(want) == 500


def test_one_label_for_all_goes_out_in_parts(spark):
    """Sums of a label are combined on the map side: no window holds it, whatever its size."""
    df = spark.createDataFrame([(k, [float(k), 1.0, 2.0, 3.0], 7, "", "", 1, 1) for k in range(200)], SCHEMA)
    plan = vector_codes.compress(df, rounds=1)._jdf.queryExecution().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan


def test_entries_fit_their_digits(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([], SCHEMA), entries=300)
