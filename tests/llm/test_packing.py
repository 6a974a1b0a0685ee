import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sluice.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_word_ids_are_the_tokenizers(tokenizer):
    draw = random.Random(2)
    odd = ["", " ", "it's DON'T 's", "Straße É́ éx à", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>y", "\x00\x7f~ 12345 3.14", "漢字かな 한국어", "ΣΑΣ σας ΟΔΟΣ", "İstanbul ǅ"]
    alphabet = "aAé'sS1 \t\ń 　<|>ﬁß漢"
    texts = odd + ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    texts += ["".join(draw.choice("abcXYZÀÖØßéÿŸµ") for _ in range(draw.randint(1, 9))) + draw.choice(["", ".", "***", "!?", "&&&", "'s", "’s", "1"]) for _ in range(300)]
    ids = packing.WordIds(packing.tokenizer_path(), remembered=50)
    assert ids.short
    for t in texts:
        assert np.frombuffer(ids(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(make_docs, odd_rows, tokenizer):
    rows = packing.pack_documents(make_docs(odd_rows), capacity=64, keep_ids=True).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"])):
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 64 and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == 64 * r["piece"]
        whole.setdefault(r["doc_id"], Counter())[r["piece"], tuple(ids.tolist())] += 1
    for i, t, *_ in odd_rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            assert whole[i][k // 64, tuple(ids[k : k + 64])] == (2 if i == 14 else 1)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.03 * -(-sum(r["length"] for r in rows) // 64) + 1


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_piece(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 50, 200])
    lengths = {n: draw.choice([1, 2, 1000]) for n in draw.sample(range(1, capacity + 1), draw.randint(1, capacity))}
    used = Counter()
    patterns = packing.plan_patterns(lengths, capacity)
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= capacity
        for n in pattern:
            used[n] += times
    assert used == Counter(lengths)


@pytest.mark.parametrize("seed", range(8))
def test_index_of_sums(seed):
    """Looked-up combinations against all of them, while counts fall."""
    draw = random.Random(seed)
    capacity = draw.choice([12, 30, 60])
    counts = np.array([0] + [draw.choice([0, 1, 2, 5]) for _ in range(capacity)])
    index = packing.SumIndex(counts, capacity)
    for _ in range(60):
        total = draw.randrange(1, capacity)
        there = {x for x in range(1, capacity) if index.counts[x]}
        pairs = {(a, total - a) for a in there if total - a in there and 2 * a > total} | ({(total // 2,) * 2} if total % 2 == 0 and index.counts[total // 2] > 1 else set())
        assert set(index.singles(total)) == ({(total,)} if total in there else set())
        assert set(index.pairs(total)) == pairs and [a for a, _ in index.pairs(total)] == sorted((a for a, _ in pairs), reverse=True)
        possible = {tuple(sorted((a, b, total - a - b))) for a in there for b in there if total - a - b in there}
        possible = {t for t in possible if all(t.count(x) <= index.counts[x] for x in t)}
        found = {tuple(sorted(t)) for t in index.triples(total)}
        assert {t for t in found if all(t.count(x) <= index.counts[x] for x in t)} == possible
        if possible:
            pattern = draw.choice(sorted(possible))
            before = [index.counts[x] for x in pattern]
            times = index.use(pattern)
            assert times > 0 and [index.counts[x] for x in pattern] == [n - times * pattern.count(x) for n, x in zip(before, pattern, strict=True)]


def test_exact_complements_first():
    patterns = dict(packing.plan_patterns({60: 3, 40: 1, 25: 1, 15: 2, 10: 1}, 100))
    assert patterns[60, 40] == 1 and patterns[60, 25, 15] == 1  # a single, then a pair; 15 + 10 is left


def test_empty(make_docs):
    assert packing.pack_documents(make_docs([])).count() == 0
    r = packing.pack_documents(make_docs([(None, None)])).collect()[0]
    assert (r["length"], r["offset"], r["ids_crc32"]) == (1, 0, zlib.crc32(b"\0\0\0\0"))
