import re

import pytest
import xxhash

from leadloom.llm import simhash as sh


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, fp, least.get(find(i))) for i, (doc, fp) in enumerate(rows)), key=str)


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_classes_match_brute_force(request, scratch, name):
    df = request.getfixturevalue(name)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in sh.near_duplicates(df, scratch).collect()), key=str)
    assert got == brute_classes([(r.doc_id, brute_fp(r.text)) for r in df.collect()])


def test_links_are_whole(spark):
    base = 0x0123456789ABCDEF
    fps = {base, *(base ^ (1 << i) for i in (0, 31, 32, 63)), *(base ^ (1 << i) ^ (1 << j) for i in (0, 5, 40) for j in (31, 33, 63)), 0, (1 << 64) - 1}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {frozenset((r.src % (1 << 64), r.dst % (1 << 64))) for r in sh.near_links(spark.createDataFrame(signed, "fp long")).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}


def test_one_of_each_class_stays(docs, edge, nothing, scratch):
    for df in (docs, edge):
        found = sh.near_duplicates(df, scratch).collect()
        kept = sh.keep_one(df, scratch)
        assert kept.columns == df.columns
        want = sorted({r.doc_id for r in found if r.doc_id is not None and r.doc_id == r.component_id})
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert sh.keep_one(nothing, scratch).count() == 0 and sh.near_duplicates(nothing, scratch).count() == 0
