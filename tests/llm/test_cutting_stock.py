import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sluice.llm import cutting_stock as C
from sluice.llm.packing import tokenizer_path


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]


def unpadded(total, capacity):
    return total == capacity or total & (total - 1) == 0


def check(rows, out, capacity):
    """Every id in one piece, pieces gapless, no sequence padded; returns the number of pieces."""
    want = Counter()
    for i, t in rows:
        want[i, tuple(whole(t))] += 1
    sequences, docs = {}, {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4") if r["ids"] is not None else None
        if ids is not None:
            assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and unpadded(at, capacity)
    have = Counter()
    for (i, n), pieces in docs.items():
        copies = sum(v for (j, ids), v in want.items() if j == i and len(ids) == n)
        assert sum(p[1] for p in pieces) == n * copies
        have[i, n] = copies
    assert sum(have.values()) == len(rows)
    single = {(i, len(ids)): ids for (i, ids), v in want.items() if v == 1}
    for key, ids in single.items():
        if sum(1 for (j, x), v in want.items() if (j, len(x)) == key) == 1:
            at = 0
            for start, length, crc in sorted(docs[key]):
                assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)


@pytest.mark.parametrize("capacity", [64, 4096])
@pytest.mark.parametrize("keep_ids", [True, False])
def test_round_trip(make_docs, odd_rows, capacity, keep_ids):
    out = C.pack_documents(make_docs(odd_rows), capacity=capacity, keep_ids=keep_ids, grid=4 if capacity == 64 else C.GRID).collect()
    assert all((r["ids"] is None) != keep_ids for r in out)
    check([r[:2] for r in odd_rows], out, capacity)


def test_shuffled_cuts(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_CUTS", 0)
    check([r[:2] for r in odd_rows], C.pack_documents(make_docs(odd_rows).repartition(6), capacity=256).collect(), 256)


def test_no_rows(make_docs):
    assert C.pack_documents(make_docs([])).count() == 0
    out = C.pack_documents(make_docs([(None, None), (None, None), (1, "")])).collect()
    assert [r["length"] for r in out] == [1, 1, 1] and len({r["sequence_id"] for r in out}) == 2


def test_patterns_fill_and_use_each_piece_once():
    draw = np.random.default_rng(3)
    for n, low in ((1, 5), (300, 1), (20_000, 1), (5000, 3000)):
        lengths = np.clip(draw.lognormal(6.0, 1.0, n).astype(int), low, 4096)
        histogram = Counter(lengths.tolist())
        patterns, left = C.plan_patterns(histogram)
        used = Counter()
        for pattern, times in patterns:
            assert unpadded(sum(pattern), 4096) and sum(pattern) <= 4096 and times > 0
            for x in pattern:
                used[x] += times
        assert all(used[x] + int(left[x]) == k for x, k in histogram.items()) and left.sum() + sum(used.values()) == n
        if n == 20_000:  # few documents are outside the patterns
            assert left @ np.arange(4097) < 0.1 * lengths.sum()


def test_program_reaches_the_optimum():
    """The value equals the best of all bases of the full program (every pattern, every left-over)."""
    draw = random.Random(2)
    for _ in range(8):
        weights = np.array(sorted(draw.sample(range(3, 20), 4)))
        counts = np.array([draw.randint(1, 30) for _ in weights])
        found = C.solve(counts, weights, [(40, 40_000)])
        assert (sum((v * c for v, _, c in found), np.zeros(4)) <= counts + 1e-6).all()
        patterns = [np.array(p) for p in itertools.product(*(range(40 // w + 1) for w in weights.tolist())) if np.dot(p, weights) == 40 and sum(p) > 1]
        columns = np.array([*patterns, *np.eye(4)], dtype=float)
        gains = np.array([40_000 - C.OVERHEAD] * len(patterns) + [0.0] * 4)
        bases = np.array(list(itertools.combinations(range(len(columns)), 4)))
        matrices = columns[bases].transpose(0, 2, 1)
        good = np.abs(np.linalg.det(matrices)) > 1e-9
        x = np.linalg.solve(matrices[good], np.broadcast_to(counts.astype(float)[:, None], (int(good.sum()), 4, 1)))[:, :, 0]
        met = (x >= -1e-9).all(1)
        best = (x[met] * gains[bases[good][met]]).sum(1).max()
        assert abs(sum(v * (t - C.OVERHEAD) for v, t, _ in found) - best) < 1e-3 * max(1.0, best)


def test_row_of_the_rest():
    counts = np.zeros(65, dtype=np.int64)
    counts[50], counts[30], counts[7] = 3, 2, 5
    row = C.Row(counts, 64, 10)
    assert row.total == 245 and row.full == 3 and [int(x) for x in row.start(np.arange(9))] == [0, 64, 128, 192, 224, 240, 244, 245, 245]
    assert row.sequence(np.array([0, 63, 64, 191, 192, 223, 224, 243, 244])).tolist() == [0, 0, 1, 2, 3, 3, 4, 5, 6]
    assert int(row.base[50]) == 0 and int(row.base[30]) == 150 and int(row.base[7]) == 210
