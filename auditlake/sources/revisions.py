"""Files of a revision, and the differences between two, as partitioned data sources over a git repository.

The driver lists names only. A partition is a set of files, whose contents its task
reads from the repository by object id, so that they are those of the listed revision
whatever happens to its name meanwhile. The repository must lie where all executors see it.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes and files that a partition holds, about.
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 2000

# What a revision's name may hold.
_REF = r"[a-zA-Z0-9_.\-/@~^]+"


def checked_ref(ref: str) -> str:
    """ref, if it is a plain revision name and no option."""
    if ref.startswith("-") or not re.fullmatch(_REF, ref):
        raise ValueError(f"not a revision name: {ref!r}")
    return ref


def _git(repo: str, *args: str, feed: bytes | None = None) -> bytes:
    found = subprocess.run(["git", "-C", repo, *args], input=feed, capture_output=True)
    if found.returncode:
        raise ValueError(f"git {args[0]}: {found.stderr.decode(errors='replace').strip()}")
    return found.stdout


def _grouped(entries: list[tuple], size_at: int, most: int) -> Iterator[list[tuple]]:
    """entries in runs of about PARTITION_BYTES, or of `most`."""
    held, size = [], 0
    for entry in entries:
        if held and (size + entry[size_at] > PARTITION_BYTES or len(held) >= most):
            yield held
            held, size = [], 0
        held.append(entry)
        size += entry[size_at]
    if held:
        yield held


def tree(repo: str, ref: str, suffix: str = "") -> list[tuple[str, str, int]]:
    """(path, object id, bytes) of the files of a revision, in order of path; links and submodules are no files."""
    out = []
    for entry in _git(repo, "ls-tree", "-r", "-z", "--long", checked_ref(ref)).split(b"\0"):
        if entry:
            head, path = entry.split(b"\t", 1)
            mode, kind, oid, size = head.split()
            name = path.decode(errors="surrogateescape")
            if kind == b"blob" and mode != b"120000" and name.endswith(suffix):
                out.append((name, oid.decode(), int(size)))
    return sorted(out)


def contents(repo: str, oids: list[str]) -> Iterator[bytes]:
    """The contents of objects, one after another, by one process."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        for oid in oids:
            run.stdin.write(f"{oid}\n".encode())
            run.stdin.flush()
            head = run.stdout.readline().split()
            if len(head) != 3:
                raise ValueError(f"no such object: {oid}")
            yield run.stdout.read(int(head[2]))
            run.stdout.read(1)
        run.stdin.close()


@dataclass
class _Files(InputPartition):
    entries: list[tuple]

    def __init__(self, entries: list[tuple]):
        self.entries = entries


def _entries(partition) -> list[tuple]:
    """Where there are no partitions, a reader is called once with none."""
    return getattr(partition, "entries", [])


def _text(data: bytes) -> str:
    return data.decode(errors="replace")


def _name(path: str) -> str:
    return path.encode(errors="surrogateescape").decode(errors="replace")


class _RevisionReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.ref, self.suffix = options["path"], checked_ref(options.get("ref", "HEAD")), options.get("suffix", "")
        self.most = int(options.get("partition_files", PARTITION_FILES))

    def partitions(self):
        return [_Files(x) for x in _grouped(tree(self.repo, self.ref, self.suffix), 2, self.most)]

    def read(self, partition):
        entries = _entries(partition)
        for (path, oid, size), data in zip(entries, contents(self.repo, [e[1] for e in entries])):
            yield (self.ref, _name(path), oid, size, _text(data))


class RevisionSource(DataSource):
    """spark.read.format("revision").option("ref", ...).load(repository): ref, path, object_id, size, content."""

    @classmethod
    def name(cls) -> str:
        return "revision"

    def schema(self) -> str:
        return "ref string, path string, object_id string, size long, content string"

    def reader(self, schema) -> DataSourceReader:
        return _RevisionReader(self.options)


class _DiffReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.base, self.ref, self.suffix = options["path"], checked_ref(options["base"]), checked_ref(options.get("ref", "HEAD")), options.get("suffix", "")

    def partitions(self):
        old, new = ({p: (oid, n) for p, oid, n in tree(self.repo, r, self.suffix)} for r in (self.base, self.ref))
        changed = [(p, (old.get(p) or (None, 0))[0], (new.get(p) or (None, 0))[0], (old.get(p) or (None, 0))[1] + (new.get(p) or (None, 0))[1]) for p in sorted(old.keys() | new.keys()) if old.get(p) != new.get(p)]
        return [_Files(x) for x in _grouped(changed, 3, PARTITION_FILES)]

    def read(self, partition):
        for path, old, new, _ in _entries(partition):
            status = "added" if old is None else "deleted" if new is None else "modified"
            if status == "modified":
                lines = _text(_git(self.repo, "diff", "--no-color", "--no-ext-diff", "--unified=0", old, new)).split("\n")
            else:
                n = next(contents(self.repo, [old or new]))
                count = n.count(b"\n") + (not n.endswith(b"\n") and bool(n))
                lines = [f"@@ -0,0 +1,{count} @@" if old is None else f"@@ -1,{count} +0,0 @@"] if count else []
            for line in lines:
                hunk = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)
                if hunk:
                    a, n, b, m = (1 if x is None else int(x) for x in hunk.groups())
                    yield (_name(path), status, a, n, b, m)


class DiffSource(DataSource):
    """spark.read.format("revision_diff").option("base", ...).option("ref", ...).load(repository): one row a hunk without context.

    path, status (added, deleted, modified), old_start, old_count, new_start, new_count.
    """

    @classmethod
    def name(cls) -> str:
        return "revision_diff"

    def schema(self) -> str:
        return "path string, status string, old_start int, old_count int, new_start int, new_count int"

    def reader(self, schema) -> DataSourceReader:
        return _DiffReader(self.options)


def revision(spark: SparkSession, repo: str, ref: str = "HEAD", suffix: str = "", partition_files: int = PARTITION_FILES) -> DataFrame:
    """The files of a revision whose path ends in suffix. Bytes that are no UTF-8 are replaced."""
    spark.dataSource.register(RevisionSource)
    return spark.read.format("revision").option("ref", checked_ref(ref)).option("suffix", suffix).option("partition_files", partition_files).load(repo)


def hunks(spark: SparkSession, repo: str, base: str, ref: str = "HEAD", suffix: str = "") -> DataFrame:
    """The changed line ranges between two revisions, by path; a renamed file is one that is gone and one that is new."""
    spark.dataSource.register(DiffSource)
    return spark.read.format("revision_diff").option("base", checked_ref(base)).option("ref", checked_ref(ref)).option("suffix", suffix).load(repo)
