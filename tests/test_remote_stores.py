"""Stores over stub clients: paging, rows, tags, errors; runs over stores that fail."""

import datetime
import io
import json
import logging

import pytest

from ledgerloom.functions import redaction
from ledgerloom.plans import control, logs, run
from ledgerloom.sources import remote
from ledgerloom.sources.listing import store_listing
from ledgerloom.sources.stores import FolderStore, ReadOnlyStore
from test_files_and_runs import NOW, seed

WHEN = datetime.datetime(2024, 4, 1, 12, tzinfo=datetime.timezone.utc)
FAST = control.RetrySettings(2, 0, 0)


class ClientError(Exception):
    def __init__(self, status, headers=None):
        super().__init__(f"status {status}")
        self.response = {"ResponseMetadata": {"HTTPStatusCode": status, "HTTPHeaders": headers or {}}}


class CodeError(Exception):
    def __init__(self, code):
        super().__init__(f"code {code}")
        self.code = code


class HttpError(Exception):
    def __init__(self, status):
        super().__init__(f"resp {status}")
        self.resp = type("R", (), {"status": status})()


class ReadTimeoutError(Exception):
    pass


class S3:
    def __init__(self):
        self.objects, self.tags, self.fails, self.asked = {}, {}, [], []

    def list_objects_v2(self, Bucket, Prefix="", ContinuationToken="0"):  # noqa: N803
        self.asked.append((Prefix, ContinuationToken))
        if self.fails:
            raise self.fails.pop()
        keys = sorted(k for k in self.objects if k.startswith(Prefix))
        at = int(ContinuationToken)
        page = {"Contents": [{"Key": k, "Size": len(self.objects[k][0]), "LastModified": WHEN, "ETag": '"%s"' % ("a" * 32 if k == "a" else "b-2")} for k in keys[at : at + 2]]}
        return page | ({"NextContinuationToken": str(at + 2)} if at + 2 < len(keys) else {})

    def head_object(self, Bucket, Key):  # noqa: N803
        if Key not in self.objects:
            raise ClientError(404)
        body, extra = self.objects[Key]
        return {"ContentLength": len(body), "LastModified": WHEN, "ETag": '"%s"' % ("c" * 32), **extra}

    def get_object_tagging(self, Bucket, Key):  # noqa: N803
        return {"TagSet": [{"Key": k, "Value": v} for k, v in self.tags.get(Key, {}).items()]}

    def put_object_tagging(self, Bucket, Key, Tagging):  # noqa: N803
        self.tags[Key] = {t["Key"]: t["Value"] for t in Tagging["TagSet"]}

    def put_object(self, Bucket, Key, Body, **extra):  # noqa: N803
        self.objects[Key] = (Body, extra)

    def upload_fileobj(self, f, bucket, key, ExtraArgs):  # noqa: N803
        self.objects[key] = (b"".join(iter(lambda: f.read(700_001), b"")), ExtraArgs)

    def get_object(self, Bucket, Key):  # noqa: N803
        body = self.objects[Key][0]
        return {"Body": type("B", (), {"iter_chunks": staticmethod(lambda chunk_size: (body[i : i + chunk_size] for i in range(0, len(body), chunk_size)))})}

    def delete_object(self, Bucket, Key):  # noqa: N803
        self.objects.pop(Key, None)


def test_s3():
    client = S3()
    s = remote.S3Store(client, "b", retries=FAST)
    big = [bytes([k]) * 1_500_000 for k in range(5)]
    for key, chunks in (("a", [b"xy"]), ("b", big), ("c", []), ("d/e", [b"1"]), ("f", [b"2"])):
        s.write(key, iter(chunks), {"n": 1}, "text/plain" if key == "a" else None)
    client.fails = [ClientError(503, {"Retry-After": "0"}), ReadTimeoutError()]
    rows = list(s.list())
    assert [r["key"] for r in rows] == ["a", "b", "c", "d/e", "f"] and [t for _, t in client.asked] == ["0", "0", "0", "2", "4"]
    assert rows[0]["provider_hash"] == "a" * 32 and rows[1]["provider_hash"] is None and rows[1]["etag"] == "b-2" and rows[0]["last_modified"] == "2024-04-01T12:00:00Z"
    assert all(r["user_metadata"] == {} and r["content_type"] is None for r in rows)
    assert [r["key"] for r in remote.S3Store(client, "b", "d/").list()] == ["d/e"]
    assert b"".join(s.read("b")) == b"".join(big) and b"".join(s.read("c")) == b""
    s.tag("a", "q", "1")
    s.tag("a", "n", "2")
    head = s.head("a")
    assert head["user_metadata"] == {"n": "2", "q": "1"} and head["content_type"] == "text/plain" and head["size_bytes"] == 2
    s.delete("a")
    assert s.head("a") is None
    client.fails = [ClientError(403)]
    with pytest.raises(remote.RequestFailed, match="403"):
        list(s.list())
    client.fails = [ClientError(500) for _ in range(9)]
    with pytest.raises(control.RetriesExhausted):
        list(s.list())


def test_mapped_errors():
    for e, wait in ((ClientError(429, {"retry-after": "7"}), 7), (CodeError(504), 0), (HttpError("503"), 0), (ReadTimeoutError(), 0), (TimeoutError(), 0), (ClientError(500, {"Retry-After": "soon"}), 0)):
        got = remote.mapped(e)
        assert isinstance(got, control.Transient) and got.retry_after_s == wait
    for e, status in ((ClientError(404), 404), (CodeError(401), 401), (HttpError("400"), 400), (ClientError(None), 0), (HttpError("odd"), 0)):
        assert remote.mapped(e).status == status
    plain = KeyError("k")
    assert remote.mapped(plain) is plain


class Blob:
    def __init__(self, held, name):
        self.held, self.name, self.metadata, self.size, self.updated, self.content_type, self.crc32c = held, name, None, None, None, None, None

    def reload(self):
        if self.name not in self.held:
            raise CodeError(404)
        self.body, notes, self.content_type = self.held[self.name]
        self.metadata, self.size, self.updated, self.crc32c = dict(notes), len(self.body), WHEN, "crc="

    def open(self, mode, chunk_size):
        return io.BytesIO(self.held[self.name][0])

    def upload_from_file(self, f, content_type=None):
        self.held[self.name] = (f.read(), self.metadata, content_type)

    def patch(self):
        self.held[self.name] = (self.body, self.metadata, self.content_type)

    def delete(self):
        if self.held.pop(self.name, None) is None:
            raise CodeError(404)


class Gcs:
    def __init__(self):
        self.held = {}

    def bucket(self, name):
        return type("Bucket", (), {"blob": lambda _, key: Blob(self.held, key)})()

    def list_blobs(self, bucket, prefix=None):
        for name in sorted(self.held):
            blob = Blob(self.held, name)
            blob.reload()
            yield blob


def test_gcs():
    s = remote.GcsStore(Gcs(), "b", retries=FAST)
    for key, chunks in (("a", [b"xy"]), ("big", [b"z" * 3_000_000] * 3), ("none", [])):
        s.write(key, iter(chunks), {"n": 1, "m": None}, "text/plain")
    s.tag("a", "q", "1")
    rows = list(s.list())
    assert [(r["key"], r["size_bytes"]) for r in rows] == [("a", 2), ("big", 9_000_000), ("none", 0)]
    assert rows[0]["user_metadata"] == {"n": "1", "m": "", "q": "1"} and rows[0]["etag"] is None and rows[0]["provider_hash"] == "crc=" and s.head("a") == rows[0]
    assert b"".join(s.read("big")) == b"z" * 9_000_000
    s.delete("a")
    assert s.head("a") is None
    with pytest.raises(remote.RequestFailed):
        s.delete("a")


class Drive:
    """``files`` by folder, two in a page."""

    def __init__(self, tree, fails=False):
        self.tree, self.fails = tree, fails

    def files(self):
        return self

    def _then(self, f):
        return type("Request", (), {"execute": staticmethod(f)})

    def get(self, fileId, **_):  # noqa: N803
        def found():
            if self.fails:
                raise HttpError(403)
            known = {f["id"]: f for fs in self.tree.values() for f in fs} | {"root": {"id": "root"}}
            if fileId not in known:
                raise HttpError(404)
            return known[fileId]

        return self._then(found)

    def list(self, q, pageToken="0", **_):  # noqa: N803
        rows, at = self.tree.get(q.split("'")[1], []), int(pageToken)
        return self._then(lambda: {"files": rows[at : at + 2]} | ({"nextPageToken": str(at + 2)} if at + 2 < len(rows) else {}))

    def get_media(self, fileId):  # noqa: N803
        return self._then(lambda: fileId.encode() * 700_000)


def test_drive():
    folder = remote.FOLDER_KIND
    tree = {
        "root": [{"id": "F", "name": "sub", "mimeType": folder}, {"id": "1", "name": "x.jpg", "mimeType": "image/jpeg", "size": "12", "createdTime": "c", "modifiedTime": "m"}, {"id": "G", "name": "last", "mimeType": folder}, {"id": "2", "name": "doc"}],
        "F": [{"id": "3", "name": "y", "size": "odd"}, {"id": "H", "name": "deep", "mimeType": folder}], "H": [{"id": "4", "name": "z"}], "G": [{"id": "5", "name": "w"}],
    }
    s = remote.DriveStore(Drive(tree), "root")
    rows = list(s.list())
    assert [(r["key"], r["user_metadata"]["drive_path"]) for r in rows] == [("1", "x.jpg"), ("2", "doc"), ("3", "sub/y"), ("4", "sub/deep/z"), ("5", "last/w")]
    assert rows[0] == {"key": "1", "size_bytes": 12, "last_modified": "m", "content_type": "image/jpeg", "user_metadata": {"drive_file_id": "1", "drive_path": "x.jpg", "createdTime": "c"}, "etag": None, "provider_hash": None}
    assert [r["size_bytes"] for r in rows[1:]] == [0, 0, 0, 0]
    assert b"".join(s.read("44")) == b"44" * 700_000 and len(next(s.read("44"))) == 1 << 20
    assert s.head("nope") is None and s.head("1")["size_bytes"] == 12
    for f in (lambda: s.write("a", iter([]), {}), lambda: s.tag("a", "b", "c"), lambda: s.delete("a")):
        with pytest.raises(ReadOnlyStore):
            f()
    with pytest.raises(control.FilesAccessFailed) as e:
        remote.DriveStore(Drive(tree, fails=True), "root")
    assert control.exit_code(e.value) == control.Exit.FILES_ACCESS_FAILED


def _breaking(roots, broken):
    def factory():
        class Breaking(FolderStore):
            ranged = False

            def list(self):
                rows = super().list()
                if str(self.root) == broken:
                    yield from [next(rows)]
                    raise OSError("page 2")
                yield from rows

        return {n: Breaking(r) for n, r in roots.items()}

    return factory


def test_listing_failures(spark, tmp_path):
    settings, s3, gcs = seed(tmp_path)
    roots = {s.name: s.root for s in settings.sources}
    whole = store_listing(spark, [*roots], lambda: {n: FolderStore(r) for n, r in roots.items()}).collect()
    assert len(whole) == sum(len(list(FolderStore(r).list())) for r in roots.values()) and all(r.list_error is None for r in whole)
    broken = _breaking(roots, str(s3.root))
    cold = run.run(spark, settings, now=NOW, apply=True, confirmed=True, stores=broken)
    assert cold.code == control.Exit.COLD_START_LISTING_FAILED
    assert [(r.action, r.result, r.source, r.error) for r in cold.ledger.collect()] == [("list-error", "error", "s3-prod", "OSError: page 2")]
    run.run(spark, settings, now=NOW, apply=True, confirmed=True)
    at = f"{settings.runtime.folder}/catalog"
    keys = {(r.source, r.key) for r in spark.read.parquet(at).collect()}
    warm = run.run(spark, settings, now=NOW, apply=True, confirmed=True, stores=broken)
    assert warm.code == control.Exit.RUN_HAD_ERRORS
    now = {(r.source, r.key) for r in spark.read.parquet(at).collect()}
    assert now >= keys and {k for s, k in now if s == "s3-prod"} == {k for s, k in keys if s == "s3-prod"}  # nothing of the failed store is gone
    assert warm.ledger.where("action IN ('quarantine', 'tombstone', 'physical-delete')").isEmpty()
    assert warm.events.where("level = 'INFO'").first().detail["removed:s3-prod"] == "0"


def test_confirmation(spark, tmp_path):
    settings, s3, _ = seed(tmp_path)
    asked = []
    no = run.run(spark, settings, now=NOW, apply=True, confirmed=True, confirm=lambda n, size: asked.append((n, size)))
    assert len(asked) == 1 and asked[0][0] > 0 and not any("quarantined-at" in x["user_metadata"] for x in s3.list())
    assert {r.result for r in no.ledger.where("action = 'quarantine'").collect()} == {"planned"}
    out = io.StringIO()
    assert control.asks(out, lambda: " Yes ", True)(2, 10) and "2 objects of 10 bytes" in out.getvalue()
    assert not control.asks(out, lambda: "", True)(2, 10)
    with pytest.raises(control.InteractiveRequired) as e:
        control.asks(out, lambda: "y", False)(2, 10)
    assert control.exit_code(e.value) == 74 and control.exit_code(ValueError()) == 2 and control.exit_code(control.SettingsError()) == 64


def test_json_lines(spark):
    out = io.StringIO()
    logger = logs.set_up("warn", out)
    assert logs.set_up("warn", out) is logger and len(logger.handlers) == 1
    with logs.bound("r1", spark):
        assert "r1" in spark.getTags()
        logger.info("unseen")
        logging.getLogger("ledgerloom.x").warning("token %s", "Bearer abc", extra={"event": "e", "nested": {"Client_Secret": [1], "list": ["AKIA" + "A" * 16, 5]}})
    logger.critical("end")
    assert "r1" not in spark.getTags()
    a, b = map(json.loads, out.getvalue().splitlines())
    assert (a["level"], a["run_id"], a["event"], a["message"], a["nested"]) == ("WARN", "r1", "e", "token [REDACTED]", {"Client_Secret": "[REDACTED]", "list": ["[REDACTED]", 5]})
    assert (b["level"], b["run_id"], b["event"]) == ("ERROR", "unset", "ledgerloom") and b["timestamp"].endswith("Z")
    with pytest.raises(ValueError):
        logs.level("loud")


def test_redact_json(spark):
    rows = [(json.dumps({"a": [{"Private_Key": {"x": 1}}, "ya29.abc"], "n": 1.5}),), ("no json Bearer abc",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(redaction.redact_json("t")).collect()]
    assert got == ['{"a":[{"Private_Key":"[REDACTED]"},"[REDACTED]"],"n":1.5}', "no json [REDACTED]", None, ""]
