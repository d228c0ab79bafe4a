"""Records whose head holds the magic, in one piece of a split and over several splits."""

import base64
import hashlib
import random

import pytest

from ledgerloom.llm.warc import read_warc, write_warc


@pytest.mark.parametrize("split", ["134217728", "900", "150"])
def test_magic_in_heads(spark, tmp_path, split):
    r = random.Random(5)
    bits = ["a", "WARC/1.", "WARC/1.1\r\n", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "x" * 60, "Content-Length: 7\r\n"]
    rows = []
    for i in range(60):
        url = f"http://x/{i}"
        if i % 3 == 0:
            url += "/WARC/1.1/spec" * r.choice([1, 2, 60])
        if i % 5 == 0:
            url += "/" + "y" * r.choice([10, 1200]) + "/WARC/1."
        rows.append((i, url, "".join(r.choice(bits) for _ in range(r.randint(0, 8)))))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(old, (split, "1"), strict=True):
        spark.conf.set(k, v)
    try:
        path = str(tmp_path / "warc")
        write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
        got = read_warc(spark, path).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(x.page_id for x in got) == [i for i, _, _ in rows]
    for x in got:
        _, url, html = rows[x.page_id]
        b = html.encode()
        assert (x.url, x.payload_bytes, x.payload_digest, x.digest_ok) == (url, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), True)
