import zlib

import numpy as np
import pytest

from leadloom.llm import packing as p
from leadloom.llm.tokens import Encoder, vocabulary


def histogram(lengths):
    return np.bincount(np.asarray(lengths, np.int64), minlength=p.LENGTH + 1)


RNG = np.random.default_rng(3)
CASES = {
    "none": [],
    "one": [5],
    "full": [4096] * 7,
    "halves": [2048] * 9,
    "same": [1500] * 1000,
    "uniform": RNG.integers(1, 4097, 4000),
    "short": RNG.integers(1, 300, 5000),
    "text": np.minimum(4096, np.exp(RNG.normal(6.6, 1.0, 6000)).astype(int) + 1),
}


@pytest.mark.parametrize("name", CASES)
def test_plan_uses_every_piece_once_and_few_sequences(name):
    lengths = np.asarray(CASES[name], np.int64)
    plan = p.Plan(histogram(lengths))
    used = np.zeros(p.LENGTH + 1, np.int64)
    for run, n in plan.runs:
        assert sum(run) <= p.LENGTH and n > 0
        np.add.at(used, list(run), n)
    assert (used == histogram(lengths)).all()
    bound = -(-int(lengths.sum()) // p.LENGTH)
    if name in ("text", "short", "uniform"):
        assert plan.sequences <= bound * 1.01 + 2
    if name == "same":
        assert plan.sequences == 500
    # places are gapless and disjoint
    rank, at = {}, {}
    places = plan.places()
    for length in sorted(lengths.tolist()):
        r = rank[length] = rank.get(length, -1) + 1
        s, o = p.locate(places, np.array([length]), np.array([r]))
        at.setdefault(int(s[0]), []).append((int(o[0]), length))
    assert len(at) == plan.sequences
    for held in at.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= p.LENGTH


def test_nnls_matches_brute_force():
    a = RNG.random((6, 4))
    for b in (RNG.random(6), -RNG.random(6), np.zeros(6)):
        x = p.nnls(a, b)
        best = min((np.linalg.norm(a[:, list(s)] @ np.linalg.lstsq(a[:, list(s)], b, rcond=None)[0] - b) for m in range(1, 16) if (s := [j for j in range(4) if m >> j & 1]) and (np.linalg.lstsq(a[:, s], b, rcond=None)[0] >= 0).all()), default=np.linalg.norm(b))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= min(best, np.linalg.norm(b)) + 1e-8


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_match_brute_force(docs, edge, nothing, scratch, length):
    path = vocabulary("word_bpe_49k.json")
    encoder = Encoder(path)
    for df in (docs, edge):
        want = []
        for r in df.collect():
            ids = encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
            want += [(r.doc_id, i // length, i, len(ids[i : i + length]), zlib.crc32(np.array(ids[i : i + length], "<u4").tobytes())) for i in range(0, len(ids), length)]
        got = p.pack(df, path, 1, scratch, length).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        held = {}
        for r in got:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in held.values():
            assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))]).tolist()[:-1] and sum(n for _, n in parts) <= length
    assert p.pack(nothing, path, 1, scratch, length).collect() == []
