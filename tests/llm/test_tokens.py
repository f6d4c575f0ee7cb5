import zlib

import numpy as np
import pytest

from leadloom.llm import elias_fano as ef
from leadloom.llm.tokens import Encoder, vocabulary
from tests.llm.conftest import EDGE

ODD = ["  a  b\n\n c\t\td \n", "don't  I'LL 's 'sx  \n\n\n", "e\u0301 x \u0301y", "\u0130stanbul \u03a3 \u03c2", "x\r\ny", " ", "\n", "<|endoftext|> hi<|endoftext|>", "a  ", " \n a", "\n\n a", "\t \ta", "\u00b5\u00aa\u00ba1\u00b2\u00bd \u00c0\u00d7\u00f7\u00df\u00ff'S x'LL \u00a7\u00b6", "'s 't '''s x's's !'s ''x", "a\u200bb c\u00a0d\x1ce\x00f"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_give_the_whole_texts_ids(name, texts):
    encoder = Encoder(vocabulary(name))
    for text in [*texts.values(), *ODD, *(r[1] for r in EDGE if r[1])]:
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole


def test_two_generations_keep_ids(texts, monkeypatch):
    monkeypatch.setattr("leadloom.llm.tokens.CACHE_WORDS", 5)
    small, large = Encoder(vocabulary("word_bpe_49k.json")), Encoder(vocabulary("word_bpe_49k.json"))
    for text in list(texts.values())[:5]:
        assert small.encode(text) == large.encode(text)
    assert len(small.words) <= 5


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [0, 1, 2, 3], [7, 7, 900, 10**9], list(range(0, 100_000, 7))])
def test_elias_fano_round_trip(values):
    coded = ef.EliasFano.build(np.array(values, np.int64))
    again, end = ef.EliasFano.read(memoryview(data := coded.to_bytes()), 0)
    assert end == len(data) and again.values().tolist() == values
    assert [again[i] for i in range(len(values))] == values


def test_size_is_near_the_bound():
    values = np.sort(np.random.default_rng(1).integers(0, 10**8, 50_000))
    assert len(ef.EliasFano.build(values).to_bytes()) * 8 / len(values) < 2.3 + np.log2(10**8 / 50_000)


def brute(rows, encoder):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [500, 1 << 21])
def test_files_hold_every_document(spark, docs, edge, scratch, shard_ids):
    path = vocabulary("byte_bpe_50k.json")
    for df in (docs, edge):
        root = scratch.path("shards")
        manifest = ef.write_token_files(df, root, path, 2, scratch, shard_ids)
        got = ef.read_token_files(manifest, root).collect()
        want = brute([(r.doc_id, r.text) for r in df.collect()], Encoder(path))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        for row in manifest.collect()[:2]:
            shard = ef.Shard(open(row.path, "rb").read())
            assert sum(len(shard.document(i)) for i in range(shard.n_docs)) == row.n_ids == shard.offset(shard.n_docs)


def test_no_rows(nothing, scratch):
    root = scratch.path("shards")
    assert ef.read_token_files(ef.write_token_files(nothing, root, vocabulary("byte_bpe_50k.json"), 2, scratch), root).collect() == []
