"""Stores behind a provider's client, which is given: nothing here imports an SDK.

A client is asked by the provider's own requests (``list_objects_v2``, ``files().list``, blobs of a
bucket), page by page until none is left. A failed request becomes ``Transient``, which callers
try again, or ``RequestFailed``. ``head`` of an object that isn't there is None in every
store. Listings hold pages, never a whole store.
"""

from __future__ import annotations

import io
import ssl
import tempfile
from collections.abc import Callable, Iterator
from datetime import datetime

from ..functions.columns import TRANSIENT_HTTP
from ..plans.control import FilesAccessFailed, RetrySettings, Transient, retried
from .stores import CHUNK, ReadOnlyStore, Store

#: The largest object written in one request, the kind of a folder, files in a page.
ONE_REQUEST = 5 << 20
FOLDER_KIND = "application/vnd.google-apps.folder"
PAGE = 1000
#: Names of SDK errors that stand for a request without an answer.
UNANSWERED = ("ConnectTimeoutError", "ReadTimeoutError", "RetryError", "Timeout", "ConnectTimeout", "ReadTimeout")


class RequestFailed(OSError):
    """A request that another try won't mend; status 0 where the provider tells none."""

    def __init__(self, status: int, message: str):
        super().__init__(f"{status}: {message}")
        self.status = status


def _number(text: object) -> float:
    try:
        n = float(str(text).strip())
    except ValueError:
        return 0.0
    return n if n >= 0 else 0.0


def told(error: Exception) -> tuple[int | None, float]:
    """(HTTP status, seconds the server asks to wait) of any provider's error; the status is None if it has none, 0 if it can't be read."""
    answer = getattr(error, "response", None)
    if isinstance(answer, dict):
        meta = answer.get("ResponseMetadata") or {}
        headers = {str(k).lower(): v for k, v in (meta.get("HTTPHeaders") or {}).items()}
        status = meta.get("HTTPStatusCode")
        return status if isinstance(status, int) else 0, _number(headers.get("retry-after", 0))
    for status in (getattr(getattr(error, "resp", None), "status", None), getattr(error, "code", None)):
        if status is not None:
            return int(status) if str(status).isdigit() else 0, 0.0
    return None, 0.0


def mapped(error: Exception) -> Exception:
    """What to raise for a provider's error; an error that is none of a provider's stays as it is."""
    if isinstance(error, (TimeoutError, ssl.SSLError)) or {c.__name__ for c in type(error).__mro__} & {*UNANSWERED}:
        return Transient(f"no answer: {type(error).__name__}")
    status, wait = told(error)
    if status is None:
        return error
    return Transient(f"{status}: {error}", wait) if status in TRANSIENT_HTTP else RequestFailed(status, str(error))


def asked(request: Callable):
    try:
        return request()
    except Exception as e:  # noqa: BLE001  SDK errors share no class
        to_raise = mapped(e)
        if to_raise is e:
            raise
        raise to_raise from e


def _time(when: datetime | None) -> str:
    return "" if when is None else when.isoformat().replace("+00:00", "Z")


def _texts(values: dict | None) -> dict[str, str]:
    return {str(k): "" if v is None else str(v) for k, v in (values or {}).items()}


class Chunks(io.RawIOBase):
    """Chunks as a file to read once."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.left = chunks, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not len(self.left):
            part = next(self.chunks, None)
            if part is None:
                return 0
            self.left = memoryview(part)
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


class _Remote(Store):
    def __init__(self, retries: RetrySettings | None = None):
        self.retries = retries or RetrySettings()

    def _paged(self, request: Callable):
        """A page of a listing, asked for again after transient errors; other requests are their callers' to repeat."""
        return retried(lambda: asked(request), self.retries)

    def _if_there(self, request: Callable):
        try:
            return asked(request)
        except RequestFailed as e:
            if e.status == 404:
                return None
            raise


class S3Store(_Remote):
    """A bucket. Markers are tags, which win over metadata of the same name; a listing asks for neither."""

    ranged = True

    def __init__(self, client, bucket: str, prefix: str = "", retries: RetrySettings | None = None):
        super().__init__(retries)
        self.client, self.bucket, self.prefix = client, bucket, prefix

    @staticmethod
    def _row(key: str, size: int, when: datetime | None, etag: str | None, content_type: str | None, metadata: dict[str, str]) -> dict:
        etag = (etag or "").strip('"') or None
        single = etag is not None and len(etag) == 32 and not set(etag) - set("0123456789abcdef")
        return {"key": key, "size_bytes": int(size), "last_modified": _time(when), "content_type": content_type, "user_metadata": metadata, "etag": etag, "provider_hash": etag if single else None}

    def list(self, after: str = "", upto: str | None = None) -> Iterator[dict]:
        where = {"Bucket": self.bucket} | ({"Prefix": self.prefix} if self.prefix else {}) | ({"StartAfter": after} if after else {})
        token = {}
        while True:
            page = self._paged(lambda t=token: self.client.list_objects_v2(**where, **t))
            for o in page.get("Contents") or []:
                if upto is not None and o["Key"] > upto:
                    return
                yield self._row(o["Key"], o.get("Size", 0), o.get("LastModified"), o.get("ETag"), None, {})
            if not page.get("NextContinuationToken"):
                return
            token = {"ContinuationToken": page["NextContinuationToken"]}

    def read(self, key: str) -> Iterator[bytes]:
        body = asked(lambda: self.client.get_object(Bucket=self.bucket, Key=key))["Body"]
        yield from filter(None, body.iter_chunks(chunk_size=CHUNK))

    def _tags(self, key: str) -> dict[str, str]:
        found = asked(lambda: self.client.get_object_tagging(Bucket=self.bucket, Key=key))
        return _texts({t["Key"]: t.get("Value") for t in found.get("TagSet") or [] if t.get("Key") is not None})

    def head(self, key: str) -> dict | None:
        head = self._if_there(lambda: self.client.head_object(Bucket=self.bucket, Key=key))
        if head is None:
            return None
        return self._row(key, head.get("ContentLength", 0), head.get("LastModified"), head.get("ETag"), head.get("ContentType"), _texts(head.get("Metadata")) | self._tags(key))

    def write(self, key: str, chunks: Iterator[bytes], metadata: dict[str, str], content_type: str | None = None) -> None:
        """One request for what is small; more is streamed in parts and never held whole."""
        extra = {"Metadata": _texts(metadata)} | ({"ContentType": content_type} if content_type else {})
        start, size = [], 0
        for c in chunks:
            start.append(c)
            size += len(c)
            if size > ONE_REQUEST:
                break
        if size <= ONE_REQUEST:
            asked(lambda: self.client.put_object(Bucket=self.bucket, Key=key, Body=b"".join(start), **extra))
        else:
            rest = Chunks(c for part in (start, chunks) for c in part)
            asked(lambda: self.client.upload_fileobj(rest, self.bucket, key, ExtraArgs=extra))

    def tag(self, key: str, name: str, value: str) -> None:
        """Other tags stay."""
        tags = [{"Key": k, "Value": v} for k, v in (self._tags(key) | {name: value}).items()]
        asked(lambda: self.client.put_object_tagging(Bucket=self.bucket, Key=key, Tagging={"TagSet": tags}))

    def delete(self, key: str) -> None:
        asked(lambda: self.client.delete_object(Bucket=self.bucket, Key=key))


class GcsStore(_Remote):
    """A bucket whose blobs carry markers in their metadata."""

    def __init__(self, client, bucket: str, prefix: str = "", retries: RetrySettings | None = None):
        super().__init__(retries)
        self.client, self.bucket, self.prefix = client, bucket, prefix

    def _blob(self, key: str):
        return self.client.bucket(self.bucket).blob(key)

    @staticmethod
    def _row(blob) -> dict:
        return {
            "key": str(blob.name), "size_bytes": int(blob.size or 0), "last_modified": _time(blob.updated), "content_type": blob.content_type,
            "user_metadata": _texts(blob.metadata), "etag": None, "provider_hash": str(blob.crc32c) if blob.crc32c else None,
        }

    def list(self) -> Iterator[dict]:
        blobs = iter(self._paged(lambda: self.client.list_blobs(self.bucket, prefix=self.prefix or None)))
        while (blob := asked(lambda: next(blobs, None))) is not None:
            yield self._row(blob)

    def read(self, key: str) -> Iterator[bytes]:
        with asked(lambda: self._blob(key).open("rb", chunk_size=CHUNK)) as f:
            while part := asked(lambda: f.read(CHUNK)):
                yield part

    def head(self, key: str) -> dict | None:
        blob = self._blob(key)
        return self._if_there(lambda: (blob.reload(), self._row(blob))[1])

    def write(self, key: str, chunks: Iterator[bytes], metadata: dict[str, str], content_type: str | None = None) -> None:
        """Metadata goes with the bytes. The client wants a file it can rewind: small ones in memory, others on disk."""
        blob = self._blob(key)
        blob.metadata = _texts(metadata)
        with tempfile.SpooledTemporaryFile(ONE_REQUEST) as f:
            for c in chunks:
                f.write(c)
            f.seek(0)
            asked(lambda: blob.upload_from_file(f, **({"content_type": content_type} if content_type else {})))

    def tag(self, key: str, name: str, value: str) -> None:
        blob = self._blob(key)
        asked(blob.reload)
        blob.metadata = _texts(blob.metadata) | {name: value}
        asked(blob.patch)

    def delete(self, key: str) -> None:
        asked(self._blob(key).delete)


class DriveStore(_Remote):
    """Files below one folder, read only; the key is the file's id. Files of a folder come before its subfolders."""

    supports_writes = False

    def __init__(self, service, folder: str, download: Callable[[object], Iterator[bytes]] | None = None, retries: RetrySettings | None = None):
        """``download`` makes chunks of a media request; by default the request is executed whole."""
        super().__init__(retries)
        self.service, self.folder, self.download = service, folder, download
        try:
            self._paged(lambda: service.files().get(fileId=folder, fields="id", supportsAllDrives=True).execute())
        except Exception as e:  # noqa: BLE001  whatever the cause, the folder is out of reach
            raise FilesAccessFailed(f"{folder}: {type(e).__name__}: {e}") from e

    @staticmethod
    def _row(file: dict, path: str) -> dict:
        size = str(file.get("size") or "")
        notes = {"drive_file_id": str(file.get("id") or ""), "drive_path": path, "createdTime": file.get("createdTime") or ""}
        return {
            "key": notes["drive_file_id"], "size_bytes": int(size) if size.isdecimal() else 0, "last_modified": file.get("modifiedTime") or "", "content_type": file.get("mimeType") or None,
            "user_metadata": notes, "etag": None, "provider_hash": None,
        }

    def list(self) -> Iterator[dict]:
        open_folders = [(self.folder, "")]
        while open_folders:
            folder, above = open_folders.pop()
            below, token = [], {}
            while True:
                query = {
                    "q": f"'{folder}' in parents and trashed=false", "pageSize": PAGE, "fields": "nextPageToken, files(id, name, mimeType, size, createdTime, modifiedTime)",
                    "supportsAllDrives": True, "includeItemsFromAllDrives": True,
                }
                page = self._paged(lambda q=query | token: self.service.files().list(**q).execute())
                for f in page.get("files") or []:
                    path = "/".join(filter(None, (above, f.get("name") or "")))
                    if f.get("mimeType") == FOLDER_KIND:
                        below.append((f["id"], path))
                    else:
                        yield self._row(f, path)
                if not page.get("nextPageToken"):
                    break
                token = {"pageToken": page["nextPageToken"]}
            open_folders += reversed(below)

    def read(self, key: str) -> Iterator[bytes]:
        request = self.service.files().get_media(fileId=key)
        if self.download:
            chunks = iter(self.download(request))
            while (part := asked(lambda: next(chunks, None))) is not None:
                yield part
            return
        whole = asked(request.execute)
        for at in range(0, len(whole), CHUNK):
            yield whole[at : at + CHUNK]

    def head(self, key: str) -> dict | None:
        fields = "id, name, mimeType, size, createdTime, modifiedTime"
        file = self._if_there(lambda: self.service.files().get(fileId=key, fields=fields, supportsAllDrives=True).execute())
        return None if file is None else self._row(file, file.get("name") or "")

    def write(self, key: str, chunks: Iterator[bytes], metadata: dict[str, str]) -> None:
        raise ReadOnlyStore(self.folder)

    def tag(self, key: str, name: str, value: str) -> None:
        raise ReadOnlyStore(self.folder)

    def delete(self, key: str) -> None:
        raise ReadOnlyStore(self.folder)
