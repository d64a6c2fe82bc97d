"""A streaming source that follows files as they grow, by byte offset.

Spark's own file stream reads each file once; this one reads what is appended. An offset is the bytes read
of each file. A micro-batch ends at the last complete line of each file, and is cut into byte ranges that
executors read side by side, so the paths must be on a file system that all of them mount. A file that
shrinks is read again from its start; one that disappears is forgotten.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, byte_offset long, content string"
#: Bytes of a file that one task reads.
RANGE = 16 << 20


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def complete_bytes(path: str, at_most: int | None = None) -> int:
    """Bytes up to and including the last newline."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END) if at_most is None else at_most
        while end > 0:
            start = max(0, end - 65536)
            f.seek(start)
            found = f.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, from_start: bool):
        self.pattern, self.from_start = pattern, from_start

    def files(self) -> list[str]:
        return sorted(p for one in self.pattern.split(",") for p in glob.glob(one.strip()) if os.path.isfile(p))

    def initialOffset(self) -> dict:  # noqa: N802
        return {} if self.from_start else {p: complete_bytes(p) for p in self.files()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: complete_bytes(p) for p in self.files()}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = 0 if stop < begin else begin
            while begin < stop:
                cut = stop if stop - begin <= RANGE else complete_bytes(path, begin + RANGE)
                cut = cut if cut > begin else stop  # a line longer than a range
                out.append(ByteRange(path, begin, cut))
                begin = cut
        return out

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                text = line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                if text:
                    yield partition.path, at, text
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: path (a glob, or several with commas between), from_start (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "logquarry_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"], self.options.get("from_start", "false").lower() == "true")


def follow(spark: SparkSession, path: str, from_start: bool = False) -> DataFrame:
    """A streaming DataFrame of the lines that the files gain."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("logquarry_tail").option("path", path).option("from_start", json.dumps(from_start)).load()
