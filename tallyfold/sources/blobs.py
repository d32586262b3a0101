"""Small named blobs in a folder of any file system that Hadoop knows: put, get, list, delete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete


class Blobs:
    """Keys are relative paths with forward slashes; a key has no `..` and no empty part."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"
        if self._local:  # without checksum files, which cannot be replaced together with a blob
            self._fs = self._fs.getRawFileSystem()

    def _at(self, key: str):
        if any(part in ("", ".", "..") for part in key.split("/")):
            raise ValueError(f"not a key: {key!r}")
        return self._path(f"{self.folder}/{key}")

    def put(self, key: str, data: bytes) -> None:
        """Write under a name of its own, then put it in the blob's place in one step: a reader finds the old blob or the new one, never none and never half of one."""
        to = self._at(key)
        part = self._path(f"{self.folder}/{key}.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        if self._local:
            how = gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            how[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.move(place(part), place(to), how)
        else:
            how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(part, to, how)

    def get(self, key: str) -> bytes | None:
        """The blob, None if there is none."""
        if not self._fs.exists(self._at(key)):
            return None
        stream = self._fs.open(self._at(key))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def list(self, prefix: str = "") -> list[str]:
        """Keys that begin with prefix, in order."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        files, found = self._fs.listFiles(self._path(self.folder), True), []
        base = self._fs.makeQualified(self._path(self.folder)).toString().rstrip("/") + "/"
        while files.hasNext():
            found.append(files.next().getPath().toString().removeprefix(base))
        return sorted(k for k in found if k.startswith(prefix) and not k.endswith(".part") and not k.rpartition("/")[2].startswith("."))

    def delete(self, key: str) -> None:
        """Without effect if there is none."""
        delete(self._at(key).toString())

    def read(self) -> DataFrame:
        """key, content of all blobs but empty ones, read on the executors."""
        base = self._fs.makeQualified(self._path(self.folder)).toString().rstrip("/") + "/"
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(self.folder)
        return files.select(F.substring("path", len(base) + 1, 1 << 20).alias("key"), "content").filter(~F.col("key").endswith(".part"))
