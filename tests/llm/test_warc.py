import hashlib

import pytest

from echofold.llm import warc
from echofold.llm.common import shared_dir

BIG = "<p>" + "x" * 1200
ROWS = [
    (1, "http://www.Example.com/a?q#f", BIG),
    (2, "http://example.com/a", BIG),
    (9, "https://m.example.com:81", BIG),
    (3, "http://b.org/é\n x", "small"),
    (4, "http://b.org/1", "small"),
    (5, None, None),
    (6, "no scheme", ""),
    (7, "http://b.org/1", "é\r\n\r\nWARC/1.1\r\n" * 100),
    (7, "http://b.org/1", "é\r\n\r\nWARC/1.1\r\n" * 100),
    (None, "http://b.org/1", BIG),
]


def brute(rows):
    best = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            best[b] = max(best.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        r = best.get(b)
        revisit = r is not None and r != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", r if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("known", [0, 1000])
def test_round_trip_and_lookup(spark, monkeypatch, known):
    monkeypatch.setattr(warc, "KNOWN_PAYLOADS", known)
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    folder = shared_dir(spark, "warc")
    warc.write(pages, folder, file_bytes=600)
    warc.build_index(spark, folder, block_lines=2, shards=3)
    assert sorted(map(tuple, warc.lookup(pages, folder).collect()), key=str) == brute(ROWS)
    for url in {r[1] for r in ROWS}:
        want = sorted([b for b in brute(ROWS) if b[0] in {r[0] for r in ROWS if warc.url_key(r[1]) == warc.url_key(url)}], key=str)
        got = warc.lookup(spark.createDataFrame([(url,)], "url string"), folder).collect()
        assert sorted(map(tuple, got), key=str) == want
        assert sorted(warc.CaptureIndex.of(spark, folder).records(url), key=str) == want
    assert warc.CaptureIndex.of(spark, folder).find("http://none.example/") == []


def test_keys():
    assert warc.url_key("http://www.Example.com/A?q=1#x") == "com,example,www)/A?q=1"
    assert warc.url_key("http://a.b:80") == "b,a:80)/"


def test_empty(spark):
    folder, none = shared_dir(spark, "warc"), spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, folder)
    warc.build_index(spark, folder)
    assert warc.lookup(none, folder).collect() == []


def test_hot_key(spark):
    """One URL for a third of all rows, over many blocks and shards."""
    pages = spark.range(300).selectExpr("id as page_id", "if(id % 3 = 0, 'http://hot.org/x', concat('http://a.org/', id)) as url", "concat('page ', id) as html")
    folder = shared_dir(spark, "warc")
    warc.write(pages, folder, file_bytes=4000)
    warc.build_index(spark, folder, block_lines=7, shards=5)
    assert sorted(r.page_id for r in warc.lookup(pages, folder).collect()) == list(range(300))
    assert sorted(r.page_id for r in warc.lookup(pages.where("page_id = 3"), folder).collect()) == list(range(0, 300, 3))
