import re

from leadloom.llm import license_scan as ls

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
ROWS = [
    (1, "the MIT License and the mit-license; a General Public License"),
    (1, "the MIT License and the mit-license; a General Public License"),
    (2, None),
    (3, ""),
    (4, "mit licence ÜMIT License mitÜ license"),
    (5, "x " * 500 + MIT + " tail" * 20),
    (6, "y " * 30 + MIT.replace("any person", "any lucky person").replace("without limitation ", "") + " z"),
    (7, "apache license" + " apache license" * 50),
    (8, "of the and of the in the to the " * 400),
    (9, "general public licenses general public license general public"),
    (None, "mit license"),
]


def brute(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places = [(i, label) for phrase, label in ls.PHRASES for n in [len(phrase.split())] for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def check(df):
    got = ls.scan_licenses(df).collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    return got


def test_base_matches_brute_force(spark, docs, edge, nothing):
    for df in (docs, edge, nothing):
        check(df)


def test_spans(spark):
    got = {r.doc_id: r for r in check(spark.createDataFrame(ROWS, "doc_id long, text string"))}
    assert got[5].labels == "mit" and got[5].score == 1.0
    assert got[6].labels == "mit" and ls.COVER <= got[6].score < 1  # edits only shift the diagonal
    assert got[8].labels == "" and got[2].score == 0
    spans = [r for r in ls.license_spans(spark.createDataFrame(ROWS, "doc_id long, text string")).where("kind = 'method' and doc_id = 5").collect()]
    assert [(r.first, r.last) for r in spans] == [(500, 500 + len(MIT.replace("and/or", "and or").split()) - 1)]


def test_plan_is_native(docs):
    plan = ls.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
