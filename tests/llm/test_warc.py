import hashlib

import zstandard
from pyarrow import fs

from sightline.llm import warc
from sightline.plans.lineage import scratch_path


def pages(spark):
    big, other = "ä<p>" * 500, "x" * 999
    rows = [(1, "http://a/1", big), (2, None, big), (9, "http://a/9\r\nX: y", big), (9, "again", big), (4, "u", other),
            (5, "u", other), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "http://é/", "Zstandard\r\n\r\nWARC/1.1"),
            (10, "u", "y" * 400_000)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)


def test_round_trip_and_revisits(spark):
    rows, df = pages(spark)
    index = warc.write(df.select("*", df["url"].alias("bundle")), scratch_path(spark, "warc"), frame_bytes=3000)
    got = warc.read(index).collect()
    assert len(got) == len(rows) and index.count() == len(rows)
    by_text = {}
    for page, url, html in rows:
        by_text.setdefault((str(page) if page is not None else None, (url or "").replace("\r", "%0D").replace("\n", "%0A")), html)
    for r in got:
        html = (by_text[(r["page_id"], r["url"] or "")] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html).hexdigest())
        revisit = len(html) >= 1000 and r["page_id"] in ("1", "2", None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", "9") if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == html


def test_frames_are_independent_and_seekable(spark):
    _, df = pages(spark)
    index = warc.write(df, scratch_path(spark, "warc"), frame_bytes=1000).collect()
    for bundle in {r["bundle"] for r in index}:
        store, path = warc._store(bundle)
        assert isinstance(store, fs.FileSystem)
        with store.open_input_file(path) as file:
            for n, (at, packed, content) in enumerate(warc.seek_table(file)):
                file.seek(at)
                text = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(packed))
                assert len(text) == content
                for r in (r for r in index if r["bundle"] == bundle and r["frame"] == n):
                    record = text[r["start"] : r["start"] + r["bytes"]]
                    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
                    assert f"<{r['record_id']}>".encode() in record


def test_one_record_by_id_and_empty(spark):
    _, df = pages(spark)
    index = warc.write(df, scratch_path(spark, "warc"))
    one = warc.read(index.where("record_id = 'urn:page:8'")).collect()
    assert [bytes(r["payload"]) for r in one] == [b"Zstandard\r\n\r\nWARC/1.1"]
    assert warc.read(warc.write(df.where("false"), scratch_path(spark, "warc"))).count() == 0
