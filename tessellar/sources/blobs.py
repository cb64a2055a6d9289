"""Blob files: reading with pruning by headers, and writing.

``read`` goes through Spark's binaryFile source and so reaches any store. :class:`BlobSource` is a Python data source for folders that
the executors can open themselves; it evaluates comparisons of ``z_min`` and ``z_max`` on the headers (of which it reads a few bytes)
and skips files before Spark sees them. Filter push-down to Python sources is a session setting (off by default); options ``low`` and ``high`` prune without it.
"""

from __future__ import annotations

import glob
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions import blob as codec
from ..functions.bits import Corrupt
from ..operators import blobs as ops

#: Files are dealt to tasks by size: what a task reads at most (but one file at least), and what opening a file counts as.
TASK_BYTES, OPEN_BYTES = 32 << 20, 128 << 10
SCHEMA = "path string, n_bands int, z_min double, z_max double, blob binary"


def read(spark: SparkSession, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """tile (number of the file in order of path), row0, path, blob of the ``.blob`` files in a folder, pruned by range."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(path).select("path", F.col("content").alias("blob"))
    tile = F.coalesce(F.try_to_number(F.regexp_extract("path", r"(\d+)\.blob$", 1), F.lit("999999999999999999")).cast("bigint"), F.xxhash64("path"))
    out = files.select(tile.alias("tile"), F.lit(0).cast("bigint").alias("row0"), "path", "blob")
    return out if low is None and high is None else ops.prune(out, float("-inf") if low is None else low, float("inf") if high is None else high)


class BlobSource(DataSource):
    """Format ``blobs``; options: path, low, high."""

    @classmethod
    def name(cls):
        return "blobs"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        cls = _PushingReader if str(self.options.get("push", "")).lower() == "true" else _Reader
        return cls(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


class _Files(InputPartition):
    """The paths of one task."""


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.rules = [("z_max", ">=", float(options["low"]))] if "low" in options else []
        self.rules += [("z_min", "<=", float(options["high"]))] if "high" in options else []

    def partitions(self):
        tasks, held = [[]], 0
        for f in sorted(glob.glob(os.path.join(self.path, "*.blob"))):
            cost = os.path.getsize(f) + OPEN_BYTES
            if tasks[-1] and held + cost > TASK_BYTES:
                tasks.append([])
                held = 0
            tasks[-1].append(f)
            held += cost
        return [_Files(t) for t in tasks]

    def read(self, partition):
        for path in partition.value:
            yield from self._rows(path)

    def _rows(self, path):
        with open(path, "rb") as f:
            head = f.read(256)
            try:
                first = codec.read_header(codec.Cursor(head))
            except Corrupt:
                return
            # with one band the first header tells; else all of them do
            if not first.more and first.version >= 6 and self._skips({"z_min": first.z_min, "z_max": first.z_max}) and not first.uses_nodata:
                return
            data = head + f.read()
        h = codec.info(data)
        if not h["uses_nodata"] and self._skips(h):
            return
        yield (path, h["n_bands"], h["z_min"], h["z_max"], data)

    def _skips(self, h) -> bool:
        test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        return any(not test[op](h[name], value) for name, op, value in self.rules)


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and f.attribute in (("z_min",), ("z_max",)):
                self.rules.append((f.attribute[0], signs[type(f)], float(f.value)))
            yield f  # stays with Spark as well: files with no-data values aren't pruned


class _Done(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class _Writer(DataSourceWriter):
    """Writes each row's ``blob``: to hidden files first, which the commit renames, so that a failed job leaves nothing behind."""

    def __init__(self, path):
        self.path = path.removeprefix("file://")

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        files = []
        for row in rows:
            name = f"{uuid.uuid4().hex}.blob"
            with open(os.path.join(self.path, f".{name}"), "wb") as f:
                f.write(bytes(row["blob"]))
            files.append(name)
        return _Done(files)

    def commit(self, messages):
        for m in messages:
            for name in m.files if m else []:
                os.rename(os.path.join(self.path, f".{name}"), os.path.join(self.path, name))

    def abort(self, messages):
        for m in messages:
            for name in m.files if m else []:
                os.remove(os.path.join(self.path, f".{name}"))
