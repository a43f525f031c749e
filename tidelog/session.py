"""Folders that all executors share, and the files adapter of the committer."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else a folder made for a session whose executor is the driver."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir().rsplit("/", 1)[0]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete checkpoints and shuffle files that nothing refers to any more, which else waits until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidelog-{kind}-{uuid.uuid4().hex}"


class Files:
    """The few file operations the committer needs, on any store Spark reaches.

    ``create`` makes a whole file appear or fails if the name is taken. On a local disk that is a hard link, which
    is atomic; elsewhere a rename that refuses to overwrite, as atomic as the store's own.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        parsed = urlparse(self.root)
        self.local = parsed.path if parsed.scheme in ("", "file") else None
        if self.local is None:
            jvm = spark._jvm
            self._path = jvm.org.apache.hadoop.fs.Path
            self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def uri(self, name: str = "") -> str:
        base = self.root if self.local is None else f"file://{os.path.abspath(self.local)}"
        return f"{base}/{name}" if name else base

    def exists(self, name: str = "") -> bool:
        return os.path.exists(f"{self.local}/{name}") if self.local is not None else self._fs.exists(self._path(self.uri(name)))

    def mkdirs(self, name: str = "") -> None:
        if self.local is not None:
            os.makedirs(f"{self.local}/{name}", exist_ok=True)
        else:
            self._fs.mkdirs(self._path(self.uri(name)))

    def list(self, name: str = "") -> dict[str, int]:
        """Names and sizes of files directly below a folder."""
        if not self.exists(name):
            return {}
        if self.local is not None:
            with os.scandir(f"{self.local}/{name}") as found:
                return {e.name: e.stat().st_size for e in found}
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(self.uri(name)))}

    def modified(self, name: str) -> float:
        """When a folder or a file in it last changed, in seconds."""
        if self.local is not None:
            top = f"{self.local}/{name}"
            return max([os.stat(top).st_mtime, *(e.stat().st_mtime for e in os.scandir(top))])
        at = self._path(self.uri(name))
        return max([self._fs.getFileStatus(at).getModificationTime(), *(s.getModificationTime() for s in self._fs.listStatus(at))]) / 1000

    def sync(self, name: str) -> None:
        """Puts the files of a folder, and their names, on the disk; other stores do so when a file is closed."""
        if self.local is None:
            return
        top = f"{self.local}/{name}"
        for path in [*(e.path for e in os.scandir(top) if e.is_file()), top, os.path.dirname(top)]:
            at = os.open(path, os.O_RDONLY)
            os.fsync(at)
            os.close(at)

    def read(self, name: str) -> bytes:
        if self.local is not None:
            with open(f"{self.local}/{name}", "rb") as f:
                return f.read()
        stream = self._fs.open(self._path(self.uri(name)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes, sync: bool = False) -> bool:
        """False if the name is taken."""
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.local is not None:
            with open(f"{self.local}/{temp}", "wb") as f:
                f.write(data)
                f.flush()
                if sync:
                    os.fsync(f.fileno())
            try:
                os.link(f"{self.local}/{temp}", f"{self.local}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self.local}/{temp}")
            if sync:
                folder = os.open(os.path.dirname(f"{self.local}/{name}"), os.O_RDONLY)
                os.fsync(folder)
                os.close(folder)
            return True
        stream = self._fs.create(self._path(self.uri(temp)), False)
        stream.write(bytearray(data))
        stream.close()
        if self._fs.exists(self._path(self.uri(name))) or not self._fs.rename(self._path(self.uri(temp)), self._path(self.uri(name))):
            self._fs.delete(self._path(self.uri(temp)), False)
            return False
        return True

    def append(self, name: str, data: bytes) -> None:
        if self.local is not None:
            with open(f"{self.local}/{name}", "ab") as f:
                f.write(data)
        else:
            self.create(f"{name}.{uuid.uuid4().hex}", data)

    def move(self, name: str, to: str) -> None:
        if self.local is not None:
            os.replace(f"{self.local}/{name}", f"{self.local}/{to}")
        else:
            self._fs.delete(self._path(self.uri(to)), True)
            self._fs.rename(self._path(self.uri(name)), self._path(self.uri(to)))

    def delete(self, name: str) -> None:
        if self.local is None:
            self._fs.delete(self._path(self.uri(name)), True)
        elif os.path.isdir(f"{self.local}/{name}"):
            shutil.rmtree(f"{self.local}/{name}")
        elif os.path.exists(f"{self.local}/{name}"):
            os.unlink(f"{self.local}/{name}")
