import random
from itertools import combinations

import numpy as np

from leadloom.llm import shingles as sl
from leadloom.llm import simhash


def brute_links(rows):
    """All pairs of (name, fp) within the ball of some common segment and the whole distance over two words."""
    out = set()
    for (a, x), (b, y) in combinations(rows, 2):
        diff = [int(u) ^ int(v) for u, v in zip(x, y, strict=False)]
        bits = sum(d << 64 * i for i, d in enumerate(diff))
        near = any(((bits >> 24 * k) & 0xFFFFFF).bit_count() <= simhash.BALL for k in range(64 * len(diff) // 24))
        if near and sum(d.bit_count() for d in diff[:2]) <= simhash.WHOLE:
            out.add((a, b))
    return out


def components(names, pairs):
    label = {n: n for n in names}
    for a, b in pairs:
        label = {n: label[a] if v == label[b] else v for n, v in label.items()} if label[a] != label[b] else label
    groups = {}
    for n, v in label.items():
        groups.setdefault(v, set()).add(n)
    return sorted(map(sorted, groups.values()))


def test_links_connect_all_pairs_in_the_balls(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        base = rng.integers(0, 1 << 63, 24 if g % 2 else 12).astype(np.uint64)
        for k in range(4):
            flips = np.packbits(rng.random(64 * len(base)) < 0.07 * k).view(np.uint64)
            rows.append((len(rows), (base ^ flips)[: 12 if k == 3 else 24]))
    df = spark.createDataFrame([(n, fp.view(np.int64).tolist()) for n, fp in rows], "name long, fp array<long>").repartition(3)
    got = [(r.src, r.dst) for r in simhash.wide_links(df).collect()]
    want = brute_links(rows)
    names = [n for n, _ in rows]
    assert components(names, got) == components(names, want) and len(want) > 40


def test_pairs_just_over_the_similarity_are_proposed():
    """Sets of 4 to 900 shingles at similarity 0.8, the worst case: at most one pair of 600 may be missed."""
    rng, missed = random.Random(7), []
    for n in (4, 8, 16, 36, 90, 900):
        for _ in range(100):
            values = [rng.getrandbits(64) for _ in range(n + n // 4)]
            cut = n // 8 if n >= 8 else 0
            one, two = values[: n + cut], values[cut:] if cut else values
            one, two = (np.array(sorted(v), np.uint64) for v in (one, two))
            assert 5 * len(np.intersect1d(one, two)) >= 4 * len(np.union1d(one, two))
            if not brute_links([(0, simhash.wide_fingerprint(one)), (1, simhash.wide_fingerprint(two))]):
                missed.append(n)
    assert len(missed) <= 1, missed


def test_the_stage_uses_simhash(spark, monkeypatch, scratch):
    """Without links from SimHash's segments there are no near copies: no plainer path stands beside them."""
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"]))], "doc_id long, text string")
    assert [r.doc_id for r in sl.keep_one_similar(docs, scratch).collect()] == [1]
    monkeypatch.setattr(sl, "wide_links", lambda sets: simhash.wide_links(sets.where("false")))
    assert sl.keep_one_similar(docs, scratch).count() == 2
