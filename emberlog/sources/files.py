"""Small Hadoop file-system helpers for table metadata (never for data)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


class Folder:
    """A folder on whatever file system its URI names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._hadoop_path(self.path).getFileSystem(conf)

    def _hadoop_path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def child(self, relative: str) -> str:
        return f"{self.path}/{relative}"

    def exists(self, relative: str) -> bool:
        return self._fs.exists(self._hadoop_path(self.child(relative)))

    def glob(self, pattern: str) -> list[str]:
        """Paths relative to the folder that match the pattern."""
        found = self._fs.globStatus(self._hadoop_path(self.child(pattern)))
        if not found:
            return []
        base = self._fs.makeQualified(self._hadoop_path(self.path)).toString().rstrip("/")
        # One text for all names: a call into the JVM per name would take seconds for thousands.
        paths = self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)
        listed = self._jvm.org.apache.commons.lang3.ArrayUtils.toString(paths)[1:-1]
        return [name[len(base) + 1:] for name in re.split(f",(?={re.escape(base)}/)", listed)]

    def read(self, relative: str) -> str:
        """Text of a small file."""
        stream = self._fs.open(self._hadoop_path(self.child(relative)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move(self, relative: str, to: str) -> None:
        """Rename a file into a folder that may not exist yet."""
        target = self._hadoop_path(self.child(to))
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._hadoop_path(self.child(relative)), target):
            raise RuntimeError(f"{relative} could not be moved to {to}")

    def publish(self, relative: str, text: str) -> bool:
        """Create a file in one step: write it aside, then rename. False when the name is taken."""
        target = self._hadoop_path(self.child(relative))
        if self._fs.exists(target):
            return False
        aside = self._hadoop_path(self.child(f"{relative}.{self._jvm.java.util.UUID.randomUUID()}.tmp"))
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        if self._fs.rename(aside, target):
            return True
        self._fs.delete(aside, False)
        return False

    def copy_of(self, other: Folder, relative: str, to: str) -> str:
        """Copy a small file of another folder here; returns its name."""
        conf, target = self._fs.getConf(), self._hadoop_path(self.child(to))
        if not self._jvm.org.apache.hadoop.fs.FileUtil.copy(other._fs, other._hadoop_path(other.child(relative)), self._fs, target, False, conf):
            raise RuntimeError(f"{relative} could not be copied to {to}")
        return to

    def keeps_times(self) -> bool:
        """Whether the store lets a file's time be set; object stores do not."""
        probe = self._hadoop_path(self.child(f"_{self._jvm.java.util.UUID.randomUUID()}.tmp"))
        self._fs.mkdirs(probe.getParent())
        self._fs.create(probe, False).close()
        try:
            self._fs.setTimes(probe, 1_000_000_000_000, -1)
            return self._fs.getFileStatus(probe).getModificationTime() == 1_000_000_000_000
        except Exception:
            return False
        finally:
            self._fs.delete(probe, False)

    def date(self, groups: list[list[str]]) -> None:
        """Set the times of files so that each group is a second younger than the one before, the last one of now."""
        now = self._jvm.java.lang.System.currentTimeMillis() // 1000 * 1000
        for back, names in enumerate(reversed(groups)):
            for name in names:
                self._fs.setTimes(self._hadoop_path(self.child(name)), now - back * 1000, -1)

    def delete(self, relative: str) -> None:
        self._fs.delete(self._hadoop_path(self.child(relative)), True)
