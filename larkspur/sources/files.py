"""Folders and small files on any file system that Spark reaches.

On a local disk files are forced to the disk and published by a hard link, which fails if the name is taken; elsewhere
by a rename that fails likewise.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        local = self.fs.getUri().getScheme() == "file"
        self.local = self.path.removeprefix("file://").removeprefix("file:") if local else None
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self, name: str = "") -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        if self.local:
            with open(f"{self.local}/{name}", encoding="utf-8") as f:
                return f.read()
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a file whole or not at all; false if the name is taken."""
        folder, _, _ = name.rpartition("/")
        self.fs.mkdirs(self._path(folder))
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.local:
            with open(f"{self.local}/{temp}", "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(f"{self.local}/{temp}", f"{self.local}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self.local}/{temp}")
            self._sync(f"{self.local}/{folder}")
            self._sync(self.local)
            return True
        out = self.fs.create(self._path(temp), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        array = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        array[0] = none
        try:
            context.rename(self._path(temp), self._path(name), array)
        except Exception:
            if self.fs.exists(self._path(name)):
                self.fs.delete(self._path(temp), False)
                return False
            raise
        return True

    def force(self, name: str) -> None:
        """Puts a folder's files on the disk, before a manifest names them."""
        if self.local:
            top = f"{self.local}/{name}"
            for f in os.listdir(top):
                self._sync(f"{top}/{f}")
            self._sync(top)
            while top != self.local:  # the folders that name it
                top = os.path.dirname(top)
                self._sync(top)

    @staticmethod
    def _sync(path: str) -> None:
        fd = os.open(path, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def age(self, name: str) -> float:
        """Seconds since a file, or the youngest file of a folder, was written; 0 if it is gone."""
        p = self._path(name)
        try:
            youngest = max((s.getModificationTime() for s in self.fs.listStatus(p)), default=0) or self.fs.getFileStatus(p).getModificationTime()
        except Exception:  # others may delete it meanwhile
            return 0.0
        return time.time() - youngest / 1000

    def size(self, name: str) -> int:
        """Bytes of a folder's files."""
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)
