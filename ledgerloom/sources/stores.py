"""Stores of objects: the interface, a store in a folder, objects that Hadoop reaches.

Stores behind a provider's client stand in ``remote``, their listings in ``listing``; a store
that Hadoop can reach is listed and read by the functions ``listing`` and ``contents`` here.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
from abc import ABC, abstractmethod
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


class ReadOnlyStore(PermissionError):
    pass


class Store(ABC):
    """What the executor of effects needs of a store."""

    supports_writes = True
    ranged = False  # whether ``list`` takes (after, upto): keys behind the one, up to the other, in the order of code points

    @abstractmethod
    def list(self) -> Iterator[dict]: ...

    @abstractmethod
    def read(self, key: str) -> Iterator[bytes]: ...

    @abstractmethod
    def head(self, key: str) -> dict | None:
        """The object's listing row, or None if there is no such object."""

    @abstractmethod
    def write(self, key: str, chunks: Iterator[bytes], metadata: dict[str, str]) -> None: ...

    @abstractmethod
    def tag(self, key: str, name: str, value: str) -> None: ...

    @abstractmethod
    def delete(self, key: str) -> None: ...


class FolderStore(Store):
    """Objects as files of one folder, named by their quoted keys; metadata in a file beside each."""

    ranged = True

    def __init__(self, root: str, supports_writes: bool = True):
        self.root, self.supports_writes = Path(root), supports_writes

    def _file(self, key: str) -> Path:
        return self.root / "objects" / quote(key, safe="")

    def _notes(self, key: str) -> Path:
        return self.root / "notes" / quote(key, safe="")

    def _may_write(self) -> None:
        if not self.supports_writes:
            raise ReadOnlyStore(str(self.root))

    def list(self, after: str = "", upto: str | None = None) -> Iterator[dict]:
        folder = self.root / "objects"
        keys = sorted(map(unquote, os.listdir(folder))) if folder.exists() else []
        for key in keys[bisect.bisect_right(keys, after) : len(keys) if upto is None else bisect.bisect_right(keys, upto)]:
            if row := self.head(key):  # else it is gone since
                yield row

    def read(self, key: str) -> Iterator[bytes]:
        with self._file(key).open("rb") as f:
            while part := f.read(CHUNK):
                yield part

    def head(self, key: str) -> dict | None:
        try:
            stat = self._file(key).stat()
        except FileNotFoundError:
            return None
        notes = json.loads(self._notes(key).read_text()) if self._notes(key).exists() else {}
        when = datetime.fromtimestamp(int(stat.st_mtime), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return {"key": key, "size_bytes": stat.st_size, "last_modified": when, "content_type": notes.get("content_type"), "user_metadata": notes.get("metadata", {}), "etag": None, "provider_hash": None}

    def _replace(self, path: Path, chunks: Iterator[bytes]) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        beside = path.with_name(f"{path.name}.{os.getpid()}.part")
        with beside.open("wb") as f:
            for c in chunks:
                f.write(c)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)

    def write(self, key: str, chunks: Iterator[bytes], metadata: dict[str, str], content_type: str | None = None) -> None:
        self._may_write()
        self._replace(self._notes(key), iter([json.dumps({"metadata": {k: str(v) for k, v in metadata.items()}, "content_type": content_type}).encode()]))
        self._replace(self._file(key), chunks)

    def tag(self, key: str, name: str, value: str) -> None:
        self._may_write()
        row = self.head(key)
        if row is None:
            raise FileNotFoundError(key)
        self._replace(self._notes(key), iter([json.dumps({"metadata": row["user_metadata"] | {name: value}, "content_type": row["content_type"]}).encode()]))

    def delete(self, key: str) -> None:
        self._may_write()
        self._file(key).unlink(missing_ok=True)
        self._notes(key).unlink(missing_ok=True)


def streamed_sha256(chunks: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def listing(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Objects below a path that Hadoop reaches, without their bytes (the scan reads no content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    null = F.lit(None).cast("string")
    return files.select(
        F.lit(source).alias("source"), F.element_at(F.split("path", f"{path.rstrip('/')}/", 2), -1).alias("key"), F.col("length").alias("size_bytes"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_modified"), null.alias("content_type"),
        F.create_map().cast("map<string,string>").alias("user_metadata"), null.alias("etag"), null.alias("provider_hash"),
    )


def contents(spark: SparkSession, source: str, path: str) -> DataFrame:
    """source, key, content: joined after the rows that need no bytes are gone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.select(F.lit(source).alias("source"), F.element_at(F.split("path", f"{path.rstrip('/')}/", 2), -1).alias("key"), "content")
