import random

import corpus_pipeline as cp
from leadloom.llm import shingles as sl


def brute_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The least id of every class of pairs with similarity 0.8 or more, over all pairs."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                label = [label[i] if k == label[j] else k for k in label]
    least = {}
    for (d, _), k in zip(rows, label, strict=True):
        least[k] = min(d, least.get(k, d))
    return sorted(least.values())


def near_copies():
    """Bases of 120 words with copies of one, two and more words changed, chains, exact copies and short texts."""
    rng, words, rows = random.Random(3), [f"w{i}" for i in range(3000)], []
    for _ in range(25):
        base = rng.choices(words, k=120)
        rows += [" ".join(base), " ".join(base).upper()]
        for changes in (1, 2, 3, 4, 8):
            copy = list(base)
            for at in rng.sample(range(120), changes):
                copy[at] = rng.choice(words)
            rows.append(" ".join(copy))
        rows.append(" ".join(base[: 120 - rng.randrange(10, 40)]))
    rows += ["", " ", "one", "One", "one two", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


def test_near_dedup_matches_brute_force_on_near_copies(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in cp.near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == brute_kept(rows) and len(kept) < 0.6 * len(rows)


def test_a_block_is_settled_exactly():
    rows = near_copies()
    label = sl.similar_classes([sl.shingle_set(t) for _, t in rows]).tolist()
    least = {}
    for (d, t), k in zip(rows, label, strict=True):
        if t.strip():
            least[k] = min(d, least.get(k, d))
    assert sorted(least.values()) == brute_kept([r for r in rows if r[1].strip()])


def test_odd_documents(edge, nothing, scratch):
    out = sl.keep_one_similar(edge, scratch)
    assert out.columns == edge.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "3", "6", "7", "8", "9", "None"]
    assert sl.keep_one_similar(nothing, scratch).count() == 0
