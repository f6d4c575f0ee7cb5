import random

import pytest

from leadloom.llm import decontaminate as d


def least(pattern, text):
    """Least edit distance of pattern to any substring, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        prev, row = row, [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(prev[i] + 1, row[-1] + 1, prev[i - 1] + (p != c)))
        best = min(best, row[-1])
    return best


def test_myers_matches_the_table():
    rng = random.Random(2)
    for _ in range(300):
        pattern, text = ("".join(rng.choices("abc", k=rng.randrange(1, n))) for n in (12, 40))
        k = rng.randrange(0, 6)
        want = least(pattern, text)
        got = d.myers_find(pattern, text, k)
        assert (got is None) == (want > k) and (got is None or got[0] == want)


def mutate(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], ["q"], [out[i], "z"]])
    return "".join(out)


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 14)))) for i in range(12)] + [(98, None), (99, " .. "), (3, "a second text under one id")]
    docs = []
    for i in range(60):
        item = rng.choice(items[:12])[1]
        body = " ".join(rng.choices(words, k=30))
        docs.append((i, body + " " + mutate(rng, item, rng.randrange(0, 9)) + "! " + body.upper() if i % 3 else body))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1].upper())]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("block_chars", [40, 4_000_000])
def test_pairs_match_brute_force(cases, block_chars):
    docs, items, rows, tests = cases
    want = []
    for doc, text in rows:
        for item, raw in tests:
            pattern = d.normalise(raw)
            if pattern and (dist := least(pattern, d.normalise(text))) <= int(len(pattern) * d.RATE):
                want.append((doc, item, dist))
    got = d.contaminated(docs, items, block_chars=block_chars).collect()
    assert sorted(((r.key, r.item_id, r.distance) for r in got), key=str) == sorted(want, key=str)
    kept = {r.doc_id for r in d.drop_contaminated(docs, items).collect()}
    assert kept == {doc for doc, _ in rows} - {doc for doc, _, _ in want}


def test_real_rows_and_no_items(spark, docs, texts, edge, nothing):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: d.normalise(r.text) for r in bench.collect()}
    whole = {(doc, i) for doc, t in texts.items() for i, p in items.items() if p in d.normalise(t)}
    got = {(r.key, r.item_id): r.distance for r in d.contaminated(docs, bench).collect()}
    assert whole <= set(got) and all(got[w] == 0 for w in whole)
    assert d.contaminated(edge, bench.limit(0)).count() == 0 and d.contaminated(nothing, bench).count() == 0
    assert d.drop_contaminated(edge, bench).count() == edge.count()
