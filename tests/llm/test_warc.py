import gzip

import pytest

from helixframe.llm.common import Shelf
from helixframe.llm.warc import archive_pages, headers, inflated, parse, read_archive, revisits, write_archive


def test_large_pages_in_files_of_their_own(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"{k}:" + "x" * (3000 * k)) for k in range(40)] + [(100, None, "y" * 700_000), (101, "http://big", "y" * 700_000), (102, "u", "z" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    shelf, path = Shelf(spark, "t"), str(tmp_path / "a")
    heads = headers(pages)
    write_archive(pages, revisits(heads, shelf), path, volume=1 << 18)
    sizes = []
    for f in (tmp_path / "a").rglob("*.gz"):
        raw = gzip.decompress(f.read_bytes())
        sizes.append(len(raw))
        n = raw.count(b"WARC-Record-ID")
        assert len(raw) <= 1 << 18 or n == 1
    assert len(sizes) > 10 and any(s < 500 for s in sizes)
    got = {r.page_id: (r.record_type, r.payload) for r in read_archive(spark, path, payloads=True).collect()}
    want = {i: ("response", t.encode()) for i, _, t in rows} | {100: ("revisit", None)}
    assert got == want
    out = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(pages).collect()}
    assert out[100] == (700_000, "revisit", 101) and out[102] == (2_000_000, "response", None)


def test_pieces():
    record = b"WARC/1.1\r\nContent-Length: 5\r\nX: y\r\n\r\nab\r\nc\r\n\r\n"
    raw = gzip.compress(record * 3) + gzip.compress(record)
    for size in (1, 7, 1 << 20):
        assert [b for _, b in parse(inflated(raw, size))] == [b"ab\r\nc"] * 4
    for bad in (record[:-2], b"x" + record, record[:20]):
        with pytest.raises(ValueError):
            list(parse([bad]))
