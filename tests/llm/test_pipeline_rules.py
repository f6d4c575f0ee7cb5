"""The pipeline's rows against brute force by each stage's own rule."""

import numpy as np

import corpus_pipeline as cp
from leadloom.llm import decontaminate, language_id, secrets
from leadloom.llm.tokens import vocabulary
from tests.llm.test_decontaminate import least
from tests.llm.test_odd_inputs import brute_prediction
from tests.llm.test_shingles import brute_kept

SF = "/root/testdata/sf0.001"


def test_run_equals_each_stages_rule(spark):
    """Near copies by all pairs of five-word shingle sets, benchmark items by the plain distance table, ids by an untouched tokenizer."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(language_id.teaching_rows(docs))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rejected = {d: bad for (d, _), (_, _, bad) in zip(rows, model.predict([t for _, t in rows]), strict=True)}
    for d, t in rows:  # what has no letter goes, and a prediction is the nearest centroid
        assert not any(c.isalpha() for c in t or "") <= rejected[d]
        assert brute_prediction(model, t)[0] == model.predict([t])[0][0]
    rows = [r for r in rows if not rejected[r[0]]]
    stay = set(brute_kept(rows))
    rows = [r for r in rows if r[0] in stay]
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = decontaminate.Items(list(enumerate(items)))
    held = {d: bool(found.search(t)) for d, t in rows}
    for d, t in rows[:25]:  # the table is slow
        text = decontaminate.normalise(t)[:400]
        assert bool(found.search(text)) == any(least(p, text) <= int(len(p) * decontaminate.RATE) for p in items if p)
    rows = [r for r in rows if not held[r[0]]]
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {}
    for d, t in rows:
        clean = secrets.redact(t) or ""
        assert not secrets.base_spans(clean)
        want[d] = len(plain.encode(clean, add_special_tokens=False).ids) + 1
    got: dict[int, int] = {}
    ends: dict[int, list[tuple[int, int]]] = {}
    for r in cp.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert got == want
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(ends) <= 1.01 * np.ceil(sum(want.values()) / 4096) + 1
