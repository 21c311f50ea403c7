"""Files of an index on any file system that Spark can write.

All access goes through Hadoop's file system classes, so a path may lie on a
local disk or in any store that Spark is set up for.
"""

from __future__ import annotations

import fcntl
import json
import re
import socket
import time
import uuid
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import Corrupt, LockObtainFailed, StorageError


#: Files up to so long are read as one value.
WHOLE_BYTES = 1 << 30


class Storage:
    """A folder; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _do(self, what: str, *args):
        try:
            return getattr(self._fs, what)(*args)
        except Py4JJavaError as e:
            raise StorageError(str(e.java_exception)) from e

    def exists(self, name: str) -> bool:
        return self._do("exists", self._path(self.at(name)))

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._do("listStatus", self._path(self.at(folder))))

    def sizes(self, folder: str) -> dict[str, int]:
        """The data files below a folder, by name from the root, with their lengths."""
        out, todo = {}, [folder]
        while todo:
            here = todo.pop()
            if not self.exists(here):
                continue
            for s in self._do("listStatus", self._path(self.at(here))):
                name = s.getPath().getName()
                if s.isDirectory():
                    todo.append(f"{here}/{name}")
                elif not name.startswith(("_", ".")):
                    out[f"{here}/{name}"] = s.getLen()
        return out

    def delete(self, name: str) -> None:
        self._do("delete", self._path(self.at(name)), True)

    def read_json(self, name: str) -> dict:
        lines = self.spark.read.text(self.at(name), wholetext=True).collect()
        try:
            return json.loads(lines[0][0])
        except (IndexError, ValueError) as e:
            raise Corrupt(f"{name} can't be read") from e

    def publish_json(self, name: str, data: dict) -> None:
        """Writes a file under another name, then renames it: readers see all of it or nothing."""
        folder, _, last = name.rpartition("/")
        self._do("mkdirs", self._path(self.at(folder)))
        pending = self._path(self.at(f"{folder}/_pending-{last}-{uuid.uuid4().hex}"))
        out = self._do("create", pending, True)
        out.write(bytearray(json.dumps(data).encode()))
        if hasattr(out, "hsync"):
            out.hsync()
        out.close()
        if self.exists(name) or not self._do("rename", pending, self._path(self.at(name))):
            self._do("delete", pending, False)
            raise StorageError(f"{name} has been published by another writer")

    def checksums(self, folders: list[str]) -> dict[str, int]:
        """The CRC-32 of every data file below the folders up to ``WHOLE_BYTES`` long, worked out by the executors. Longer ones can't be one value of a row; ``read_pages`` is for those."""
        there = [f for f in folders if self.sizes(f)]
        if not there:
            return {}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([self.at(f) for f in there])
        start = len(urlparse(self.at("")).path)
        try:
            rows = files.where(F.col("length") <= WHOLE_BYTES).select("path", F.crc32("content").alias("crc")).collect()
        except Exception as e:
            hit = re.search(r"(?:file|hdfs|[a-z0-9]+):/+\S*?([^/\s]+\.parquet)", str(e))
            raise Corrupt(f"{hit[1] if hit else 'a file'} can't be read") from e
        return {urlparse(r["path"]).path[start:]: r["crc"] for r in rows}

    def read_pages(self, folder: str) -> None:
        """Reads all pages of a folder's files and holds each against the checksum that was written with it."""
        try:
            self.spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(self.at(folder)).write.format("noop").mode("overwrite").save()
        except Exception as e:
            raise Corrupt(f"{folder} can't be read") from e

    def lock(self) -> Lock:
        return Lock(self)

    def break_lock(self) -> None:
        """Takes the lock from a writer that is known to be dead, where it is a file."""
        self.delete("write.lock")


class Lock:
    """Keeps other writers away: a lock of the operating system on local disks, a file that may not exist yet elsewhere.

    Such a file says whose it is. It outlives a driver that dies; ``Storage.break_lock`` is for that.
    """

    def __init__(self, storage: Storage):
        self.storage, self.file = storage, None
        storage._do("mkdirs", storage._path(storage.root))
        where = storage.at("write.lock")
        if storage._fs.getScheme() == "file":
            self.file = open(urlparse(where).path, "a")  # noqa: SIM115
            try:
                fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                self.file.close()
                raise LockObtainFailed(where) from e
        else:
            try:
                out = storage._fs.create(storage._path(where), False)
            except Py4JJavaError as e:
                try:
                    owner = storage.read_json("write.lock")
                except Exception:  # it may be gone by now, or not written yet
                    owner = "somebody"
                raise LockObtainFailed(f"{where}, held by {owner}") from e
            sc = storage.spark.sparkContext
            out.write(bytearray(json.dumps({"host": socket.gethostname(), "application": sc.applicationId, "since": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}).encode()))
            out.close()

    def release(self) -> None:
        if self.file is not None:
            if not self.file.closed:
                fcntl.flock(self.file, fcntl.LOCK_UN)
                self.file.close()
        elif self.storage is not None:
            self.storage.delete("write.lock")
        self.storage = None


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with _mid: the number of the partition (from bit 33 on) and of the row in it."""
    return df.withColumn("_mid", F.monotonically_increasing_id())
