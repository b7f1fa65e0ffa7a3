"""Archives: an exact round trip, the ZIP64 records, other writers' files, and what is not stored."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pytest

from tiltmeter.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, zip64):
    big = "<p>größe</p>" * 20
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "tiny"), (4, "u", "tiny"), (5, "v", None), (6, "w", "")]
    rows += [(7, "long", "x" * 300_000), (1, "again", big), (None, "no id", big), (8, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n" * 30)]
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(pages(spark, rows), folder, archive_bytes=2000, zip64=zip64)
    got = warc.read_archives(archives, folder, range_bytes=500).collect()
    assert sum(r.records for r in archives.collect()) == len(got) == len(rows) and archives.count() > 1
    for r in got:
        same = [h for i, _, h in rows if i == r.page_id]
        payload = (same[0] or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
        revisit = same[0] == big and r.page_id != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert r.payload == (None if revisit else payload)


def test_no_pages(spark):
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(pages(spark, []), folder)
    assert warc.read_archives(archives, folder).count() == 0


def test_members_of_other_writers():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        archive.writestr("archive/ä.warc.gz", b"stored", zipfile.ZIP_STORED)
        archive.writestr("pages.json", b"packed " * 50, zipfile.ZIP_DEFLATED)
        with archive.open("big", "w", force_zip64=True) as member:
            member.write(b"wide")
        archive.comment = b"PK\5\6 a comment that looks like an end"
    members = warc.zip_members(raw, len(raw.getvalue()))
    assert [(n, raw.getvalue()[at : at + size]) for n, at, size, _ in members] == [("archive/ä.warc.gz", b"stored"), ("big", b"wide")]


def test_zip64_is_read_by_others(tmp_path):
    with open(tmp_path / "x.zip", "wb") as sink:
        writer = warc.ZipWriter(sink, zip64=True)
        for name in ("a", "b"):
            writer.begin(name)
            writer.write(name.encode() * 1000)
            writer.end()
        writer.close()
    with zipfile.ZipFile(tmp_path / "x.zip") as archive:
        assert archive.testzip() is None and archive.read("b") == b"b" * 1000


def test_broken_archives():
    with pytest.raises(ValueError):
        warc.zip_members(io.BytesIO(b"not a zip"), 9)
