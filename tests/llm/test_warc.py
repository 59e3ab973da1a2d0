import base64
import gzip
import hashlib
import io
import os
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from wardlake.llm import warc

PAGES = "page_id long, url string, html string"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def rows_of(df):
    return sorted(
        (tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()),
        key=repr,
    )


def test_round_trip_with_revisits_nulls_and_ties(spark):
    same = "<p>é same</p>"
    pages = [
        (1, "http://a/1", same), (2, "http://a/2", same), (7, None, same), (3, "http://a/3\r\nX: y%0A", "x" * 300_000),
        (4, "", None), (5, "u", ""), (None, "n", same), (6, "twice", "t"), (6, "twice", "t"), (-8, "neg", "only"),
    ]
    found = rows_of(warc.round_trip(spark.createDataFrame(pages, PAGES)))
    expected = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        last = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        other = last is not None and page_id != last
        expected.append((page_id, len(payload), sha1(payload), "revisit" if other else "response", last if other else None))
    assert found == sorted(expected, key=repr)


def test_payloads_and_urls_come_back(spark, tmp_path):
    pages = [(k, f"http://x/{k}\n%0A" if k % 3 else None, "é\r\n\r\n" * k) for k in range(40)]
    manifest = warc.write_archives(spark.createDataFrame(pages, PAGES), f"file://{tmp_path}/w", min_revisit=10**9)
    back = {r.page_id: r for r in warc.read_archives(manifest, split_bytes=97).collect()}
    assert len(back) == 40 and all(r.record_type == "response" for r in back.values())
    for page_id, url, html in pages:
        assert (back[page_id].url, bytes(back[page_id].payload).decode()) == (url, html)
    assert manifest.agg({"records": "sum"}).first()[0] == 40


def test_min_revisit_size(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "xxx"), (4, "d", "xxx")], PAGES)
    kinds = {r.page_id: r.record_type for r in warc.round_trip(pages, min_revisit=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table_and_clashing_columns(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    odd = spark.createDataFrame([(1, "u", "h", "d", 5)], PAGES + ", _digest string, _salt int")
    assert warc.round_trip(odd).count() == 1


@pytest.mark.parametrize("split", [1, 50, 333, 10_000_000])
def test_every_record_is_owned_by_exactly_one_range(tmp_path, split):
    path = f"{tmp_path}/a.warc.gz"
    members = [warc.record_bytes(k, f"u{k}", os.urandom(k * 7).hex().encode(), None, False) for k in range(12)]
    # Bytes that look like a member but are none, between two of them.
    members.insert(5, warc.MAGIC + b"\x00" * 20)
    with open(path, "wb") as out:
        out.write(b"".join(members))
    length, seen = os.path.getsize(path), []
    with fs.LocalFileSystem().open_input_file(path) as source:
        for begin in range(0, length, split):
            seen += [m.offset for m in warc.ArchiveRange(source, length, begin, begin + split).members()]
    sizes = [len(m) for m in members]
    expected = [sum(sizes[:k]) for k in range(len(members)) if k != 5]
    assert seen == expected


def test_archive_is_plain_gzip_and_truncation_is_an_error(tmp_path):
    raw = warc.record_bytes(1, "u", b"hello", None, False)
    assert gzip.open(io.BytesIO(raw)).read().startswith(b"WARC/1.1\r\n")
    path = f"{tmp_path}/b.warc.gz"
    with open(path, "wb") as out:
        out.write(raw[:-4])
    with fs.LocalFileSystem().open_input_file(path) as source, pytest.raises((EOFError, zlib.error)):
        list(warc.ArchiveRange(source, len(raw) - 4, 0, len(raw)).members())


def test_corrupt_payload_is_noticed():
    content = gzip.decompress(warc.record_bytes(1, "u", b"hello", None, False)).replace(b"hello", b"jello")
    with pytest.raises(ValueError):
        warc.parse_record(content)


def test_listing_finds_archives_by_path(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "h")], PAGES), f"{tmp_path}/w")
    assert warc.read_archives(warc.list_archives(spark, f"{tmp_path}/w")).first().page_id == 1


def test_many_ranges_are_read_by_many_tasks(spark, tmp_path):
    """Adaptive execution does not put the rows that describe ranges into one task."""
    pages = [(k, f"u{k}", os.urandom(40).hex()) for k in range(300)]
    manifest = warc.write_archives(spark.createDataFrame(pages, PAGES).coalesce(2), f"file://{tmp_path}/w")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    size = manifest.agg({"bytes": "sum"}).first()[0]
    records = warc.read_archives(manifest, split_bytes=size // 100)
    tasks = records.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 8 and sum(row["count"] for row in tasks) >= 300
