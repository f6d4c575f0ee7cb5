"""Nulls, foreign values, clashing names and very long texts, operator by operator."""

import gzip
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadloom.llm import decontaminate, elias_fano, language_id, license_scan, media, secrets, shingles, simhash, warc
from leadloom.llm.tokens import Encoder, vocabulary
from leadloom.scratch import Scratch

SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y", "<|END", "<|endoftext|><|endoftext|> tail", "say <|EndOfText|> twice", "<|endoftext|>\n\n q", "plain text"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_give_the_plain_librarys_ids(name):
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name))
    held = [t.content for t in plain.get_added_tokens_decoder().values()]
    for text in SPECIAL + held + [f"in {t} the middle" for t in held]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_token_files_hold_added_tokens(spark, scratch):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    plain, root = Tokenizer.from_file(path), scratch.path("shards")
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in elias_fano.read_token_files(elias_fano.write_token_files(docs, root, path, 2, scratch), root).collect()}
    want = {i: np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(SPECIAL)}
    assert got == {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in want.items()}


def test_null_item_ids_and_short_items(spark):
    items = spark.createDataFrame([(None, "what is the capital of france"), (1, "a"), (2, "cat"), (None, None), (3, "!!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "A cat sat"), (3, "What is the CAPITAL of France?"), (4, None), (5, "concatenate"), (6, "an a")], "doc_id long, text string")
    found = sorted(((r.key, r.item_id) for r in decontaminate.contaminated(docs, items).collect()), key=str)
    assert found == [(2, 1), (2, 2), (3, None), (6, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [1, 4, 5]


def seconds(work):
    began = time.process_time()
    work()
    return time.process_time() - began


LONG = {
    "letters": "key = " + "z" * 1_000_000, "marks": "key=" * 250_000, "paths": "/key/a1" * 150_000, "words": "token: " * 150_000,
    "spans": "password=abcdef123456789012345 " * 30_000, "many": "".join(f"key = {i:07d}abcQ{i * 7919:09d}xZ " for i in range(20_000)),
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_secret_scans_of_long_texts(name):
    assert seconds(lambda: secrets.scan(LONG[name])) < 20


PAGES = {"head": "<head " * 100_000, "title": "<title>" * 100_000, "open": "<" * 600_000, "links": "<a " * 200_000 + ">", "comments": "<!--" * 100_000, "scripts": "<script>" * 100_000, "types": "<!doctype " * 80_000, "heads": "<head>" * 100_000 + "</head>", "closed": "<title>x</title>" * 60_000}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_derivatives_of_long_pages(name):
    assert seconds(lambda: warc.derive(warc.response(1, "http://a/", PAGES[name]))) < 10


def test_license_scans_of_long_texts(spark):
    def run(n):
        text = "lorem ipsum dolor " * (n // 3) + "the mit license"
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        (row,) = license_scan.scan_licenses(rows).collect()
        assert row.n_words == n // 3 * 3 + 3 and row.n_base == 1 and row.first_word == n // 3 * 3 + 1
        return time.time() - began

    run(3_000)
    small, large = run(100_000), run(1_000_000)
    assert large < 60 and large < 40 * max(small, 0.5)


def brute_labels(text):
    """Labels of the method, by comparing every template with every place of a text word by word."""
    words = license_scan_words(text)
    out = {label for phrase, label in license_scan.PHRASES for n in [len(phrase.split())] for i in range(len(words)) if words[i : i + n] == phrase.split()}
    for template, label in license_scan.TEMPLATES:
        t = template.split()
        grams = {(t[i], t[i + 1]): i for i in range(len(t) - 1)}
        if any(all(words[i + j : i + j + 1] == [w] for j, w in enumerate(t)) for i in range(len(words) - len(t) + 1)):
            out.add(label)
        assert grams
    return out


def license_scan_words(text):
    import re

    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_whole_notices_give_their_labels(spark):
    rows = [(i, "some words before " + template.upper().replace(" ", ", ") + " and after") for i, (template, _) in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert brute_labels(text) <= got[i]


def test_a_tag_mark_inside_a_payload_is_payload():
    for payload in (b"a" * 89 + b"TAG" + b"b" * 100, b"x" * (192 + 89) + b"TAG" + b"y" * 100):
        data = media.store_payload(payload)
        stream = media.parse(data)
        assert media.read_payload(data, stream) == payload and "TIT2" not in stream.tags
    tagged = media.store_payload(b"p" * 192) + b"TAG" + b"A song".ljust(125, b"\0")
    stream = media.parse(tagged)
    assert stream.tags["TIT2"] == "A song" and media.read_payload(tagged, stream) == b"p" * 192 and stream.skipped == 0


def test_foreign_media(spark):
    head = bytes([0xFF, 0xF3, 0x14, 0xC0])
    short = bytearray(head.ljust(media.header(head + bytes(4), 0).size, b"\0"))
    rows = [(1, None), (2, b""), (3, b"not audio"), (4, bytes(short) * 3), (5, media.store_payload(b"q" * 192)[200:]), (None, media.store_payload(b"r" * 192, {"bytes": "x"}))]
    for size in (48, 52):
        frame = bytearray(bytes([0xFF, 0xF3, 0x24, 0xC0]).ljust(size, b"\0"))
        frame[36:40] = b"VBRI"
        rows.append((size, bytes(frame) + bytes(frame)[:20]))
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].media_bytes is None and got[1].feature is None and got[2].media_bytes == 0 and got[3].n_frames == 0
    assert got[4].n_frames == 3 and got[4].n_bytes is None and got[None].n_bytes is None and got[None].payload_bytes == 192


def brute_feature(data):
    """Frames, duration and offsets, by walking headers one by one from the end of the tag."""
    at, offsets, samples = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]), [], 0
    while at < len(data):
        h = media.header(data, at)
        offsets.append(at)
        samples += h.samples
        at += h.size
    offsets, samples = offsets[1:], samples - h.samples  # the first frame holds the table
    return f"frames={len(offsets)};hz={h.rate};us={samples * 1_000_000 // h.rate};crc={len(offsets)}/{len(offsets)};table=Info:{len(offsets)};skipped=0;seek={zlib.crc32(np.array(offsets, '<i8').tobytes()):08x}"


def test_features_equal_a_walk_over_headers(docs, scratch):
    stored = scratch.save(media.store_texts(docs), "media")
    want = {r.doc_id: brute_feature(bytes(r.media)) for r in stored.collect()}
    assert {r.doc_id: r.feature for r in media.read_media(stored).collect()} == want


def test_bad_records_do_not_stop_a_job(spark, scratch):
    good = warc.response(1, "http://a/", "<p>x</p>")
    rows = [("g", good), ("cut", good[:-20]), ("junk", b"no record"), ("size", good.replace(b"Content-Length: ", b"Content-Length: x", 2)), ("none", None), ("meta", warc.derive(good)[0][2])]
    made = warc.derivatives(spark.createDataFrame(rows, "key string, record binary"))
    kinds = sorted((r.key, r.kind) for r in made.collect())
    assert kinds == [("cut", "unreadable"), ("g", "conversion"), ("g", "metadata"), ("junk", "unreadable"), ("none", "unreadable"), ("size", "unreadable")]
    assert warc.write_records(made, scratch.path("warc"), scratch).count() == 2


def test_bodies_are_decoded():
    text = "café 中"
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in (b"<p>on", b"e</p>")) + b"0\r\n\r\n"
    cases = [
        ({"content-encoding": "gzip"}, gzip.compress(text.encode()), text), ({"content-encoding": "deflate"}, zlib.compress(text.encode()), text), ({"content-encoding": "gzip"}, text.encode(), text),
        ({"transfer-encoding": "chunked"}, chunked, "<p>one</p>"), ({"transfer-encoding": "chunked"}, b"zz\r\nx", "zz\r\nx"), ({"content-type": "text/html; charset=iso-8859-1"}, b"caf\xe9", "café"),
        ({}, b'<meta charset="windows-1252">\x80', '<meta charset="windows-1252">€'), ({"content-type": "text/html; charset=none-such"}, b"a\xff", "a�"),
    ]
    for headers, body, want in cases:
        assert warc.decoded(headers, body) == want


def test_existing_archives(spark, tmp_path):
    records = [warc.response(i, f"http://a/{i}", f"<title>t{i}</title><p>body {i}") for i in range(5)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:3])))
    (tmp_path / "two.warc").write_bytes(b"".join(records[3:]) + b"WARC/1.1\r\ncut")
    (tmp_path / "three.warc.gz").write_bytes(gzip.compress(b"".join(records[:2])))
    read = warc.read_archives(spark, str(tmp_path))
    assert sorted(bytes(r.record) for r in read.collect()) == sorted([*records, *records[:2], b"WARC/1.1\r\ncut"])
    assert warc.derivatives(read).where("kind <> 'unreadable'").count() == 14


def brute_derivation(html):
    """Title, language, charset, links and text, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.title, self.lang, self.charset, self.links, self.depth = None, "", "", [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "html" and not self.lang:
                self.lang = (a.get("lang") or "").lower()
            if tag == "meta" and not self.charset:
                self.charset = (a.get("charset") or "").lower()
            if tag == "a" and a.get("href") is not None:
                self.links.append(" ".join(a["href"].split()))
            if tag == "title" and self.title is None:
                self.title = ""
                self.depth.append(tag)

        def handle_endtag(self, tag):
            if self.depth and tag == self.depth[-1]:
                self.depth.pop()

        def handle_data(self, data):
            if self.depth:
                self.title += data

    reader = Reader()
    reader.feed(html or "")
    return " ".join((reader.title or "").split()), reader.lang, reader.links


def test_derivatives_equal_a_parsers(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    agree = 0
    for p in pages:
        meta = warc.parse(warc.derive(warc.response(p.page_id, p.url, p.html))[0][2])[1].decode("utf-8", "surrogatepass")
        fields = [line.partition(": ")[::2] for line in meta.split("\r\n") if line]
        title, lang, links = brute_derivation(p.html)
        assert next(v for k, v in fields if k == "title") == title and next(v for k, v in fields if k == "languages") == lang
        agree += [v for k, v in fields if k == "outlink"] == links
    assert agree >= 0.98 * len(pages)  # a parser also sees links inside templates


def test_dirty_languages_and_bounded_samples(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    words = {"aa": "alpha beta gamma delta", "bb": "uno dos tres cuatro", "cc": "eins zwei drei vier"}
    rows = [(i, f"{words[lang]} {i % 7} {words[lang][::-1]}", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 300)] + [(1000 + i, "junk text here", f"dirty{i}") for i in range(50)]
    rows += [(5000, "alpha beta gamma delta", "aa")] * 400
    labelled = spark.createDataFrame(rows, "key long, text string, lang string")
    model = language_id.fit(labelled, sample=40)
    assert sorted(set(model.langs)) == ["aa", "bb", "cc"]
    place = F.shiftrightunsigned(F.xxhash64("key", "text"), 1)
    assert labelled.where("lang = 'aa'").where(place < 40 / 700 * float(1 << 63)).dropDuplicates(["key", "text"]).count() < 120


def brute_prediction(model, text):
    """The nearest centroid of a text, from n-grams counted one by one."""
    import re

    joined = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    raw = f" {joined} ".encode("utf-8", "surrogatepass")
    seen: dict[int, int] = {}

    def add(code, mult):
        dim = ((code * mult) & 0xFFFFFFFF) >> 19
        seen[dim] = seen.get(dim, 0) + 1

    for b in raw[1:-1]:
        add(b + 7, 2654435761)
    for i in range(len(raw) - 1):
        add(raw[i] << 8 | raw[i + 1], 2246822519)
    for i in range(len(raw) - 2):
        add((raw[i] << 8 | raw[i + 1]) << 8 | raw[i + 2], 3266489917)
    v = np.zeros(language_id.DIMENSIONS)
    for dim, n in seen.items():
        v[dim] = (1 + np.log(n)) * model.idf[dim]
    v /= np.linalg.norm(v)
    cosines = [float(v @ c) for c in model.centroids]
    best = int(np.argmax(cosines))
    return model.langs[best], cosines[best]


def test_predictions_equal_brute_force(spark, docs, texts):
    model = language_id.fit(language_id.teaching_rows(docs))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op2_language_id(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in texts.items():
        lang, score = brute_prediction(model, text)
        assert got[doc_id][0] == lang and abs(got[doc_id][1] - min(1.0, max(0.0, score))) < 1e-4


def test_clashing_names(spark, scratch):
    rows = [(1, "one two three four five six seven", "x", 1), (2, "one two three four five six seven", "y", 2), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__simhash` string, name long").withColumnRenamed("name", "keys").withColumn("c0", F.lit("c"))
    for work in (simhash.keep_one, shingles.keep_one_similar):
        out = work(docs, Scratch(spark, "clash"))
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_chunks_of_a_block_give_the_same_classes(spark):
    from tests.llm.test_shingles import brute_kept, near_copies

    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in shingles.keep_one_similar(docs, Scratch(spark, "chunks"), chunk=3).collect())
    assert kept == brute_kept(rows)


def test_settled_tasks_hold_two_chunks_at_most(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: i % 90], f"x{i}", *base[i % 90 :]])) for i in range(200)]
    texts = pa.array([t for _, t in rows])
    whole = shingles.similar_classes([shingles.shingle_set(t.as_py()) for t in texts])
    kept = shingles.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "hot"), chunk=16).count()
    assert kept == len(set(whole.tolist()))
