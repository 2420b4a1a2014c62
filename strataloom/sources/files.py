"""Small files of any store that the session reaches, through Hadoop's file systems on the driver."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


#: Stores whose rename copies: a file is created there under the condition that there is none.
OBJECT_STORES = ("s3a", "s3", "gs", "abfs", "abfss", "oss", "cosn")


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        # Hadoop's local file system has no atomic create; the operating system does.
        uri = self._path(self.root).toUri()
        self._local = uri.getPath() if (uri.getScheme() or "file") == "file" and str(self._fs.getScheme()) == "file" else None
        # The checksum layer of local files adds hidden files of its own.
        self._fs.setWriteChecksum(False)

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read_json(self, name: str) -> Any:
        data = self.read(name)
        return None if not data else json.loads(data)

    def _put(self, name: str, data: bytes, overwrite: bool) -> None:
        stream = self._fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def create_json(self, name: str, value: Any) -> bool:
        """Writes a new file whole; False if there is one already."""
        data = json.dumps(value, sort_keys=True).encode()
        if self._local is None and str(self._fs.getScheme()) in OBJECT_STORES:
            return self._create(name, data)
        side = f"{name}.{uuid.uuid4().hex}.tmp"
        self._put(side, data, True)
        try:
            if self._local is not None:
                os.link(f"{self._local}/{side}", f"{self._local}/{name}")
                return True
            self._fs.mkdirs(self._at(name).getParent())
            return bool(self._fs.rename(self._at(side), self._at(name)))  # refuses a target that is there
        except Exception:  # some stores raise where the target is there
            return False
        finally:
            self._fs.delete(self._at(side), False)

    def _create(self, name: str, data: bytes) -> bool:
        """Creates the file in one conditional request of the store; False if there is one already."""
        builder = self._fs.createFile(self._at(name)).overwrite(False).recursive()
        builder.opt("fs.s3a.create.conditional.overwrite", True)
        try:
            stream = builder.build()
            stream.write(bytearray(data))
            stream.close()  # the request that can fail
        except Exception:
            return False
        return True

    def write_json(self, name: str, value: Any) -> None:
        self._put(name, json.dumps(value, sort_keys=True).encode(), True)

    def claim(self, name: str, value: Any) -> bool:
        """Creates the file unless it is there, in one step of the store: for locks."""
        data = json.dumps(value, sort_keys=True).encode()
        try:
            if self._local is not None:
                os.makedirs(os.path.dirname(f"{self._local}/{name}"), exist_ok=True)
                with open(f"{self._local}/{name}", "xb") as f:
                    f.write(data)
            elif str(self._fs.getScheme()) in OBJECT_STORES:
                return self._create(name, data)
            else:
                self._put(name, data, False)
        except Exception:
            return False
        return True

    def take(self, name: str, value: Any) -> bool:
        """Removes the file if it still holds `value`: of several that try, one succeeds."""
        side = f"{name}.{uuid.uuid4().hex}.taken"
        try:
            if not self._fs.rename(self._at(name), self._at(side)):
                return False
        except Exception:
            return False
        mine = self.read_json(side) == value
        if not mine and not self.exists(name):  # another's, written since
            self._fs.rename(self._at(side), self._at(name))
            return False
        self._fs.delete(self._at(side), False)
        return mine

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._at(name), True)

    def names(self, folder: str) -> list[str]:
        """The files and folders in a folder, by name."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def matching(self, pattern: str) -> list[str]:
        """The files that a glob pattern names, relative to the root, by name."""
        found = self._fs.globStatus(self._at(pattern)) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(str(s.getPath().toUri().getPath()).split("/")[-depth:]) for s in found)
