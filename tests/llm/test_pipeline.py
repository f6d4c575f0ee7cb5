import corpus_pipeline as cp
from leadloom.llm import decontaminate, language_id, secrets
from leadloom.llm.tokens import Encoder, vocabulary
from tests.llm.test_simhash import brute_classes, brute_fp

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(language_id.teaching_rows(docs))
    rows = docs.orderBy("doc_id").collect()
    rows = [r for r, (_, _, rejected) in zip(rows, model.predict([r.text for r in rows]), strict=True) if not rejected]
    least = {d: c for d, _, c in brute_classes([(r.doc_id, brute_fp(r.text)) for r in rows])}
    rows = [r for r in rows if least[r.doc_id] == r.doc_id]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = decontaminate.Items(bench)
    rows = [r for r in rows if not items.search(r.text)]
    encoder = Encoder(vocabulary("word_bpe_49k.json"))
    want = {}
    for r in rows:
        want[r.doc_id] = len(encoder.tokenizer.encode(secrets.redact(r.text) or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in cp.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and len(got) > 100


def test_stages_take_odd_documents(spark, edge, nothing):
    assert len(cp.STAGES) == 5
    for _, stage in cp.STAGES[:-1]:
        for df in (edge, nothing):
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count()
    assert cp.STAGES[-1][1](spark, edge, SF).count() >= edge.count()
