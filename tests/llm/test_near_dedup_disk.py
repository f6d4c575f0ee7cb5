"""What near-dedup shuffles: whole rows once, and the texts of sets only that are near by all bits of their fingerprints."""

from itertools import combinations

import numpy as np

from leadloom.llm import shingles as sl
from leadloom.llm import simhash
from tests.llm.test_shingles import brute_kept, near_copies
from tests.llm.test_wide_simhash import components


def chance_rows(n=30):
    """Fingerprints that agree in their first 128 bits and in no others but for those of every third, which is near its predecessor."""
    rng = np.random.default_rng(8)
    head, rows = rng.integers(0, 1 << 63, 2).astype(np.uint64), []
    for k in range(n):
        fp = np.concatenate([head, rng.integers(0, 1 << 63, 10 + 12 * (k % 2)).astype(np.uint64)])
        if k % 3 == 2:
            flips = np.packbits(rng.random(64 * 10) < 0.12).view(np.uint64)
            fp = np.concatenate([head, rows[-1][1][2:12] ^ flips])
        rows.append((k, fp))
    return rows


def test_whole_links_equal_all_pairs(spark):
    rows = chance_rows()
    want = set()
    for (a, x), (b, y) in combinations(rows, 2):
        differ = [(int(u) ^ int(v)).bit_count() for u, v in zip(x, y, strict=False)]
        if sum(differ[:2]) <= simhash.WHOLE and 4 * sum(differ) <= 64 * len(differ):
            want.add((a, b))
    df = spark.createDataFrame([(n, fp.view(np.int64).tolist()) for n, fp in rows], "name long, fp array<long>")
    blocks = spark.createDataFrame([(n, 0) for n, _ in rows], "node long, root long")
    for chunk in (4, 100):
        got = [(r.src, r.dst) for r in simhash.whole_links(df, blocks, chunk).collect()]
        assert components(range(len(rows)), got) == components(range(len(rows)), want)
    assert 10 <= len(want) < 20


def test_no_text_is_settled_for_a_link_by_chance(spark, scratch, monkeypatch):
    rows = [(n, n, f"a b c d e {n}", fp.view(np.int64).tolist()) for n, fp in chance_rows() if n % 3 < 2]
    texts = []

    def counted(members, blocks, chunk):
        texts.append(simhash.pairs_of_chunks(members, blocks, chunk).count())
        return simhash.pairs_of_chunks(members, blocks, chunk)

    monkeypatch.setattr(sl, "pairs_of_chunks", counted)
    sets = scratch.save(spark.createDataFrame(rows, "name long, first long, text string, fp array<long>"), "sets")
    assert simhash.wide_links(sets.select("name", "fp")).count() >= len(rows) - 1  # all in one component
    assert sl.similar_sets(sets, scratch, 2).count() == 0 and texts == [0]


def test_the_result_shuffles_no_text(spark, scratch):
    rows = near_copies()
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        out = sl.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch)
        plan = out.where("doc_id is not null")._jdf.queryExecution().executedPlan()
        todo, shuffled = [plan], []
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                shuffled.append(node.output().mkString(","))
        shuffled = [x for x in shuffled if "c1#" in x and "c0#" in x]
        assert not shuffled
        assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
