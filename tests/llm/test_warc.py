import re

import pytest

from leadloom.llm import warc as w

HTML = '<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{x}</style></head><body><!-- c <b>no</b> --><script>var t="</p>";</script><h1>Un</h1><p>deux  &lt;3 <b>trois</b></p><a href="/x?a=1&amp;b=2">lien</a><a href=\'y\'>z</a></body></html>'
PAGES = [(1, "http://a.example/", HTML), (1, "http://a.example/", HTML), (2, None, None), (3, "", ""), (None, "http://b/\r\nX: y", "plain <b>text"), (4, "http://c/", "<script>never closed"), (5, "http://d/", "é中" * 40_000)]


def test_derivation():
    record = w.response(1, "http://a.example/", HTML)
    source, block, end = w.parse(record)
    assert end == len(record) and source["warc-payload-digest"] == w.digest(HTML.encode()) and w.digest(block) == source["warc-block-digest"]
    (k1, meta_id, meta), (k2, text_id, text) = w.derive(record)
    for kind, own, data in ((k1, meta_id, meta), (k2, text_id, text)):
        h, body, end = w.parse(data)
        assert (h["warc-type"], h["warc-record-id"], h["warc-refers-to"]) == (kind, own, source["warc-record-id"])
        assert h["warc-target-uri"] == "http://a.example/" and h["warc-date"] == source["warc-date"] and h["warc-block-digest"] == w.digest(body) and end == len(data)
    assert w.parse(text)[1].decode() == "Un\ndeux <3 trois\nlienz"
    assert w.parse(text)[0]["warc-source-payload-digest"] == source["warc-payload-digest"]
    fields = w.parse(meta)[1].decode()
    assert "title: A & B\r\n" in fields and "languages: fr\r\n" in fields and "source-content-type: text/html; charset=utf-8\r\n" in fields
    assert re.findall("outlink: (.*)\r\n", fields) == ["/x?a=1&b=2", "y"]
    assert w.derive(record) == w.derive(record) and w.derive(meta) == []


def test_bad_records():
    with pytest.raises(ValueError):
        w.parse(b"HTTP/1.1 200\r\n\r\n")
    with pytest.raises(ValueError):
        w.parse(w.response(1, "u", "body")[:-8])


def test_files_round_trip(spark, scratch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    root = scratch.path("warc")
    made = w.derivatives(w.responses(pages))
    index = w.write_records(made, root, scratch, file_bytes=2000)
    read = w.read_records(index, root)
    pick = lambda df: sorted(((r.key, r.kind, r.record_id, bytes(r.record)) for r in df.select("key", "kind", "record_id", "record").collect()), key=str)
    assert pick(read) == pick(made) and index.count() == 2 * len(PAGES)
    rows = w.summaries(read).collect()
    want = sorted(((k, kind, rid, len(w.parse(rec)[1])) for p, u, h in PAGES for k in [p] for kind, rid, rec in w.derive(w.response(p, u, h))), key=str)
    assert sorted(((r.page_id, r.kind, r.record_id, r.n_bytes) for r in rows), key=str) == want and all(r.digest_ok for r in rows)
    assert w.derivatives(w.responses(pages.limit(0))).count() == 0


def test_query_covers_every_page(spark):
    rows = w.op8_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    want = {(p.page_id, kind, w.digest(w.parse(rec)[1])) for p in pages for kind, _, rec in w.derive(w.response(p.page_id, p.url, p.html))}
    assert {(r.page_id, r.kind, r.block_digest) for r in rows} == want and len(rows) == 2 * len(pages)
