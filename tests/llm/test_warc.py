import gzip
import hashlib
import random

from vidra.llm import warc
from vidra.llm.warc import _Reader, pages_to_records, read_warc, round_trip, write_warc


def digest(html):
    return hashlib.sha256((html or "").encode()).hexdigest()


def test_round_trip(spark):
    big = "é" * 60
    rows = [(5, "http://a", big, "x"), (3, "http://b\r\nX: y", big, "x"), (9, None, big, "x"), (9, None, big, "x"), (None, "u", big, "x"), (1, "u", "short", "x"), (2, "u", "short", "x"), (7, "u", None, "x"), (8, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted(round_trip(spark, pages).collect(), key=str)
    want = []
    for page, _, html, _ in rows:
        revisit = html == big and page != 3
        want.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert round_trip(spark, pages.limit(0)).count() == 0


def test_filters_reach_the_headers_and_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "y" * 200 if i % 2 else f"page {i}") for i in range(20)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    write_warc(spark, pages_to_records(spark, pages), path)
    rows = read_warc(spark, path, "bytes").filter("record_type = 'revisit' and page_id in (3, 5)")
    assert sorted((r.page_id, r.refers_to, r.payload) for r in rows.collect()) == [(3, 1, None), (5, 1, None)]
    assert read_warc(spark, path, "bytes").filter("page_id = 4").collect()[0].payload == b"page 4"
    assert read_warc(spark, path, "none").filter("target_uri = 'http://h/7'").collect()[0].payload_bytes is None


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = lambda a, b: pages_to_records(spark, spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in range(a, b)], "page_id long, url string, html string"))
    ids = lambda: sorted(r.page_id for r in read_warc(spark, path).collect())
    write_warc(spark, pages(0, 5), path)
    write_warc(spark, pages(5, 8), path)
    assert ids() == list(range(8))
    write_warc(spark, pages(20, 22), path, "overwrite")
    assert ids() == [20, 21] and len(list((tmp_path / "w").glob("*.warc.gz"))) <= 2
    write_warc(spark, pages(30, 31), path)
    assert ids() == [20, 21, 30]


def test_several_splits_and_long_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    rng = random.Random(1)
    text = lambda i: "".join(rng.choice("abcdefghij") for _ in range(3_000_000 if i == 7 else rng.randrange(3000)))
    rows = [(i, None if i % 5 else f"http://x/{'u' * 2000}", text(i)) for i in range(300)]
    rows[11] = (11, "u", rows[7][2])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    write_warc(spark, pages_to_records(spark, pages), path, splitBytes=20_000, fileBytes=200_000)
    got = read_warc(spark, path, "bytes", partitionBytes=50_000)
    assert got.rdd.getNumPartitions() > 5
    have = {r.page_id: r for r in got.collect()}
    assert len(have) == 300 and have[11].record_type == "revisit" and have[11].payload_bytes == 3_000_000
    assert all(bytes(have[i].payload).decode() == html for i, _, html in rows if i != 11)
    assert sorted(r.page_id for r in got.filter("page_id in (3, 7, 299)").collect()) == [3, 7, 299]


def test_groups_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, "u", None if i % 4 == 0 else f"{i % 7} " * 100) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    columns = ["page_id", "record_type", "refers_to", "payload_bytes"]
    want = sorted(map(tuple, pages_to_records(spark, pages).select(*columns).collect()))
    monkeypatch.setattr(warc, "MAX_BROADCAST_GROUPS", 2)
    assert sorted(map(tuple, pages_to_records(spark, pages).select(*columns).collect())) == want


def test_files_of_others(tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x\r\nContent-Length: 28\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\n" + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    reader = _Reader({"path": str(tmp_path), "payload": "bytes"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["target_uri"], r["payload"]) for r in rows] == [("http://x", b"hi\n")] * 4
    # Unwanted members are passed over, wanted ones behind them found.
    other = one.replace(b"http://x", b"http://y")
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(other + b"z" * 300_000) + gzip.compress(one))
    reader.tests = [("target_uri", ["http://x"])]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 5
