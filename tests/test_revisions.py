"""Revision and diff sources over a small repository, through to API regressions and touched units."""

import subprocess

import pytest
from pyspark.sql import functions as F

from auditlake.functions import parsing
from auditlake.operators import compare
from auditlake.sources import revisions


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=n", "-c", "user.email=e@example.com", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (path / "pkg").mkdir()
    (path / "pkg" / "a.py").write_text("def kept(x, y=1):\n    return x\n\n\ndef gone():\n    pass\n\n\ndef changed(a, b):\n    return a\n")
    (path / "pkg" / "old.py").write_text("class Old:\n    pass\n")
    (path / "pkg" / "é b.py").write_text("def odd():\n    pass\n")
    (path / "notes.txt").write_bytes(b"\xff not text\n")
    (path / "link.py").symlink_to("pkg/a.py")
    git("add", "-A")
    git("commit", "-q", "-m", "one")
    git("tag", "v1")
    (path / "pkg" / "a.py").write_text("def kept(x, y=1):\n    return x\n\n\ndef changed(b, a):\n    return a\n")
    (path / "pkg" / "old.py").unlink()
    (path / "pkg" / "new.py").write_text("def new():\n    pass\n")
    git("add", "-A")
    git("commit", "-q", "-m", "two")
    return str(path)


def test_files_of_a_revision(spark, repo):
    got = {r["path"]: r["content"] for r in revisions.revision(spark, repo, "v1").collect()}
    assert sorted(got) == ["notes.txt", "pkg/a.py", "pkg/old.py", "pkg/é b.py"]
    assert got["pkg/old.py"] == "class Old:\n    pass\n" and got["notes.txt"].startswith("�")
    assert revisions.revision(spark, repo, "v1", partition_files=2).rdd.getNumPartitions() == 2
    assert {r["path"] for r in revisions.revision(spark, repo, suffix=".py").collect()} == {"pkg/a.py", "pkg/new.py", "pkg/é b.py"}
    for bad in ("-x", "a b", "$(x)"):
        with pytest.raises(ValueError):
            revisions.revision(spark, repo, bad)
    with pytest.raises(Exception, match="ls-tree"):
        revisions.revision(spark, repo, "nowhere").collect()


def test_hunks(spark, repo):
    got = sorted(tuple(r) for r in revisions.hunks(spark, repo, "v1", suffix=".py").collect())
    assert got == [("pkg/a.py", "modified", 5, 5, 5, 1), ("pkg/new.py", "added", 0, 0, 1, 2), ("pkg/old.py", "deleted", 1, 2, 0, 0)]
    assert revisions.hunks(spark, repo, "v1", "v1").count() == 0


def test_regressions_between_two_revisions(spark, repo):
    side = lambda ref: revisions.revision(spark, repo, ref, ".py").select(F.col("path").alias("file_path"), F.explode(parsing.api_signatures_col("content")).alias("s")).select("file_path", "s.*")
    got = {(r["file_path"], r["key"], r["regression"]) for r in compare.signature_regressions(side("v1"), side("main")).collect()}
    assert got == {("pkg/a.py", "gone", "deleted_function"), ("pkg/a.py", "changed", "reordered"), ("pkg/old.py", "class:Old", "deleted_class")}


def test_units_that_a_change_touches(spark, repo):
    units = spark.createDataFrame([("pkg/a.py", "kept", 1, 2), ("pkg/a.py", "changed", 5, 6), ("pkg/new.py", "new", 1, 2), ("pkg/é b.py", "odd", 1, 2)], "file_path string, name string, start int, end int")
    changed = revisions.hunks(spark, repo, "v1").select(F.col("path").alias("file_path"), F.col("new_start").alias("low"), (F.col("new_start") + F.greatest(F.col("new_count"), F.lit(1)) - 1).alias("high"))
    assert sorted(r["name"] for r in compare.touched_units(units, changed).collect()) == ["changed", "new"]
