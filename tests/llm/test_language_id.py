import zlib

import numpy as np

from leadloom.llm import language_id as li


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_and_teaching_rows(spark):
    rows = li.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(langs)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in tested) / len(tested) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.005


def test_edges(edge, nothing):
    model = li.fit(li.teaching_rows(edge))
    got = {r.doc_id: r for r in li.identify(edge.select("doc_id", "text"), model).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {3, 4, 5, 9}
    assert all(got[d].score == 0 and got[d].rejected for d in (3, 4, 5, 9))
    kept = li.keep_identified(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 8}
    assert not {3, 4, 5, 9} & {r.doc_id for r in kept.collect()}
    untaught = li.fit(nothing.selectExpr("text", "lang", "doc_id as key"))
    assert {r.lang_pred for r in li.identify(edge.select("doc_id", "text"), untaught).collect()} == {"und"}
    assert li.identify(nothing.select("doc_id", "text"), model).count() == 0


def test_counts_match_a_plain_loop():
    text = "Héllo, Wörld 42 x"
    data = (" " + " ".join(li._GAP.sub(" ", text.lower()).split()) + " ").encode()
    want = np.zeros(li.DIMENSIONS, int)
    for i in range(len(data)):
        if 0 < i < len(data) - 1:
            want[(data[i] + 7) * 2654435761 % 2**32 >> 19] += 1
        if i + 1 < len(data):
            want[(data[i] << 8 | data[i + 1]) * 2246822519 % 2**32 >> 19] += 1
        if i + 2 < len(data):
            want[(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 3266489917 % 2**32 >> 19] += 1
    dims, n = li.counts(text)
    assert dims.tolist() == np.flatnonzero(want).tolist() and n.tolist() == want[want > 0].tolist()


def test_centroids_and_rejection():
    rng = np.random.default_rng(1)
    x = np.abs(np.concatenate([rng.normal([5, 0, 0], 0.2, (20, 3)), rng.normal([0, 5, 0], 0.2, (20, 3))]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = li.spherical_kmeans(x, 2)
    assert sorted(c.argmax(1).tolist()) == [0, 1] and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    assert len(li.spherical_kmeans(np.repeat(x[:1], 5, 0), 3)) == 1


def test_foreign_script_is_rejected(spark):
    rows = [(i, " ".join(["the quick brown fox and the lazy dog", "over the hill they ran again"][i % 2 :]) * (1 + i % 3), "en") for i in range(60)]
    model = li.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert model.predict(["быстрая лиса прыгает через ленивую собаку снова"])[0][2]
    assert not model.predict(["the lazy dog and the quick fox ran over the hill"])[0][2]
