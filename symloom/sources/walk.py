"""A directory tree as a table of files."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.schema import FAMILY_OF, SKIP_DIRS

#: How many directories below the root a scan goes, as the reference has it; deeper files are no part of a corpus.
MAX_DEPTH = 20
LISTED = "path string, rel_path string, ext string, lang string, size bigint, mtime_ns bigint, error string"
FILE = f"file_id bigint, {LISTED}"


def _enters(e: os.DirEntry, depth: int) -> bool:
    return depth < MAX_DEPTH and e.name not in SKIP_DIRS and not e.name.startswith(".")


def walk(root: str, overlays: set[str] = frozenset(), start: str | None = None, depth: int = 0, deep: bool = True) -> Iterator[tuple[str, str, str, int, int, str | None]]:
    """(path, rel_path, ext, size, mtime_ns, error) of every file with a known ending, down to a depth of 20.

    Only directories are skipped for their names; files that begin with `_` or `.` count. A file with unsaved edits is
    left to the overlay. What can't be read is reported in `error`, a directory with an empty ending. With `start`, only
    what lies below it, or in it without `deep`; paths are relative to `root` all the same.
    """
    rel = lambda path: os.path.relpath(path, root).replace(os.sep, "/")
    todo = [(start or root, depth)]
    while todo:
        here, depth = todo.pop()
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError as x:
            yield here, rel(here), "", 0, 0, str(x)
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if deep and _enters(e, depth):
                    todo.append((e.path, depth + 1))
                continue
            ext = e.name.rsplit(".", 1)[-1] if "." in e.name else ""
            if ext not in FAMILY_OF or e.path in overlays:
                continue
            try:
                s = e.stat()
                yield e.path, rel(e.path), ext, s.st_size, s.st_mtime_ns, None
            except OSError as x:
                yield e.path, rel(e.path), ext, 0, 0, str(x)


def _parts(root: str, least: int) -> list[tuple[str, int, bool]]:
    """(directory, depth, whole): the tree in at least `least` parts, if it has as many directories. Only directories
    near the root are listed, and only their directories are kept; one that is taken apart is a part of its own."""
    whole, apart = deque([(root, 0)]), []
    while whole and len(whole) + len(apart) < least:
        here, depth = whole.popleft()
        try:
            below = [(e.path, depth + 1) for e in os.scandir(here) if e.is_dir(follow_symlinks=False) and _enters(e, depth)]
        except OSError:  # reported by the walk
            below = []
        apart.append((here, depth, False))
        whole.extend(below)
    return [*apart, *((d, n, True) for d, n in whole)]


def corpus_files(spark: SparkSession, root: str, overlays: set[str] = frozenset(), parts: int | None = None) -> DataFrame:
    """The walk as a table, listed by tasks; contents are not read yet. `file_id` is unique within one evaluation: write
    the table before it is used twice."""
    found = _parts(root, parts or 8 * spark.sparkContext.defaultParallelism)
    jobs = spark.createDataFrame(found, "start string, depth int, deep boolean").repartition(len(found))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in LISTED.split(", ")]
        for b in batches:
            for start, depth, deep in zip(b["start"], b["depth"], b["deep"], strict=True):
                rows = []
                for path, rel, ext, size, mtime, error in walk(root, overlays, start, int(depth), bool(deep)):
                    rows.append((path, rel, ext, FAMILY_OF.get(ext), size, mtime, error))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return jobs.mapInPandas(run, LISTED).select(F.monotonically_increasing_id().alias("file_id"), "*")


def read_contents(files: DataFrame) -> DataFrame:
    """`content` of each file, bad UTF-8 replaced; `error` where it can't be read. Only rows that reach here are read, so
    filter to what changed first."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for path, error in zip(b["path"], b["error"], strict=True):
                if error:  # not even listed
                    texts.append(None)
                    errors.append(error)
                    continue
                try:
                    with open(path, "rb") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                    errors.append(error)
                except OSError as x:
                    texts.append(None)
                    errors.append(str(x))
            yield b.assign(content=texts, error=errors)

    return files.mapInPandas(run, f"{FILE}, content string")


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))
