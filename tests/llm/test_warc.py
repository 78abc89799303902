import gzip

import pytest
from pyspark.sql import functions as F

from auditlake.llm import warc

SCHEMA = "record_id string, type string, url string, date string, profile string, status int, headers map<string,string>, payload_sha256 string, payload_bytes long, canon string, part int"


def test_records_round_trip(spark, tmp_path):
    one = warc.record("response", "urn:1", "http://a/", "2024-01-01T00:00:00Z", warc.http_block("200 OK", [("ETag", '"x"'), ("Set-Cookie", "a"), ("Set-Cookie", "b")], b"body\r\n\r\nmore"))
    two = warc.record("revisit", "urn:2", None, "2024-01-02T00:00:00Z", warc.http_block("304 Not Modified", []), warc.NOT_MODIFIED)
    info = warc.record("warcinfo", "urn:0", None, "2024-01-01T00:00:00Z", b"software: x\r\n")
    want = [("urn:1", "response", "http://a/", 200, {"etag": '"x"', "set-cookie": "a, b"}, b"body\r\n\r\nmore"), ("urn:2", "revisit", None, 304, {}, b"")]
    for raw in (info + one + two, b"".join(gzip.compress(x) for x in (info, one, two)), info + one + two + one[:-20]):
        assert [(r[0], r[1], r[2], r[5], dict(r[6]), r[9]) for r in warc.parse(raw)] == want
    assert list(warc.parse(b"")) == [] and list(warc.parse(gzip.compress(one)[:-30])) == []
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one + two))
    (tmp_path / "y.warc").write_bytes(b"")
    got = warc.read(spark, str(tmp_path)).collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in got] == [("urn:1", b"body\r\n\r\nmore"), ("urn:2", b"")]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Ex.com:80/a?b=2&a=1&utm_source=x#top", "ex.com/a?a=1&b=2"), ("https://ex.com", "ex.com/"), ("http://u:p@www2.ex.com/?gclid=1", "ex.com/"),
        (None, None), ("ex.com/A%20b?", "ex.com/A%20b"),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def _rows():
    full = lambda i, url, day, tag, size=3, status=200: (i, "response", url, day, None, status, {"etag": tag, "content-type": "text/html", "x": "old"} if tag else {"x": "old"}, "sha" + i, size, "c", 1)
    again = lambda i, url, day, headers: (i, "revisit", url, day, warc.NOT_MODIFIED, 304, headers, "none", 0, "c", 1)
    return [
        full("r1", "http://a/1", "2024-01-01T00:00:00Z", '"t1"'), full("r2", "https://A/1#x", "2024-01-03T00:00:00Z", '"t2"'), full("r3", "http://a/1", "2024-01-02T00:00:00Z", '"bad"', status=500),
        again("v1", "http://a/1", "2024-01-02T12:00:00Z", {"etag": 'W/"t1"', "x": "new", "content-type": "no", "y": "1"}),
        again("v2", "http://a/1", "2024-01-04T00:00:00Z", {"etag": '"t1"'}),
        again("v3", "http://a/1", "2024-01-01T00:00:00Z", {"etag": '"t1"'}),
        again("v4", "http://a/1", "2024-01-09T00:00:00Z", None),
        again("v5", None, "2024-01-09T00:00:00Z", {}), again("v6", "http://a/1", "not a date", {}), again("v7", "http://other/", None, {}),
    ]


def test_outcomes(spark):
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(_rows(), SCHEMA)).collect()}
    assert {k: (r["outcome"], r["response_id"]) for k, r in got.items()} == {
        "v1": ("resolved", "r1"), "v2": ("mismatch", None), "v3": ("missing", None), "v4": ("unvalidated", "r2"),
        "v5": ("missing", None), "v6": ("missing", None), "v7": ("missing", None),
    }
    assert got["v1"]["headers"] == {"etag": 'W/"t1"', "content-type": "text/html", "x": "new", "y": "1"}
    assert got["v1"]["payload_sha256"] == "shar1" and got["v2"]["headers"] == {"etag": '"t1"'}
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_url_over_many_ranges(spark):
    rows = []
    for k in range(600):
        date = f"2024-01-{1 + k // 24:02d}T{k % 24:02d}:00:00Z"
        if k % 50 == 0:
            rows.append((f"r{k}", "response", "http://hot/", date, None, 200, {"etag": f'"{k}"'}, "s", 1, "c", 1))
        else:
            rows.append((f"v{k}", "revisit", "http://hot/", date, warc.NOT_MODIFIED, 304, {"etag": f'"{k - k % 50}"'}, "n", 0, "c", 1))
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA), ranges=16).collect()
    assert len(got) == 588 and all(r["outcome"] == "resolved" and r["response_id"] == f"r{int(r['record_id'][1:]) // 50 * 50}" for r in got)


@pytest.mark.parametrize("length", ["x", "-5", "", "1e3", "\u0661", None])
def test_a_record_without_a_legible_length_is_left_out(length):
    good = warc.record("response", "urn:1", "http://a/", "2024-01-01T00:00:00Z", warc.http_block("200 OK", [], b"body"))
    head = [b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: <urn:bad>", *([] if length is None else [f"Content-Length: {length}".encode()])]
    bad = b"\r\n".join([*head, b"", b""]) + b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    after = warc.record("response", "urn:2", "http://b/", "2024-01-01T00:00:00Z", warc.http_block("abc OK", [("Content-Length", "-1")], b"more"))
    assert [(r[0], r[5]) for r in warc.parse(good + bad + after)] == [("urn:1", 200), ("urn:2", None)]
    assert [r[0] for r in warc.parse(gzip.compress(bad + after))] == ["urn:2"]
