"""A streaming source that follows growing files: offsets by inode, rotation, half lines held back (ST1)."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, path string, inode long, offset long"
#: Bytes read at once while looking for the last line's end.
BLOCK = 1 << 16


@dataclass
class Stretch(InputPartition):
    path: str
    inode: int
    start: int
    end: int


def complete(path: str, size: int) -> int:
    """Bytes of the file up to and with its last line end within ``size``."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            begin = max(0, at - BLOCK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


class TailReader(DataSourceStreamReader):
    """Offsets are path -> [inode, bytes read].

    A file under another inode, or shorter than what was read, has been rotated
    and is read from its start.  Lines rotated away before they were read are
    lost, unless the pattern also names the file they went to: offsets follow the
    inode there.  What a batch read is read again after a failure, so delivery is
    at least once; ids by path, inode and offset let later steps drop repeats.
    """

    def __init__(self, pattern: str) -> None:
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                stat = os.stat(path)
                out[path] = [stat.st_ino, complete(path, stat.st_size)]
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = {inode: read for inode, read in start.values()}
        out = []
        for path, (inode, size) in end.items():
            read = known.get(inode, 0)
            begin = read if read <= size else 0
            if size > begin:
                out.append(Stretch(path, inode, begin, size))
        return out

    def read(self, part: Stretch) -> Iterator[tuple]:
        path = part.path
        if not os.path.exists(path) or os.stat(path).st_ino != part.inode:
            # Rotated since the batch was planned: the inode may live on under another name.
            moved = [p for p in glob.glob(f"{part.path}*") if os.stat(p).st_ino == part.inode]
            if not moved:
                return
            path = moved[0]
        with open(path, "rb") as f:
            f.seek(part.start)
            at = part.start
            while at < part.end:
                line = f.readline()
                if not line:
                    return
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text:
                    yield text, part.path, part.inode, at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """``spark.readStream.format("memspark_tail").option("path", pattern)``: value, path, inode and offset of each complete line.

    The files have to be readable under the same path by the driver and the
    executors: a shared folder, or one machine.
    """

    @classmethod
    def name(cls) -> str:
        return "memspark_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tail)
