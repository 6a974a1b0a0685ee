import random
import zlib

from sluice.llm import sharding


def check(rows, got, shards):
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    where, slots = {}, {}
    for r in got:
        body = text[r["doc_id"]]
        assert r["size"] == len(body.encode()) + 1 and r["text_crc32"] == zlib.crc32(body.encode()) and 0 <= r["shard"] < shards
        assert where.setdefault(body, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_odd_rows(make_docs, odd_rows):
    check(odd_rows, sharding.shard_documents(make_docs(odd_rows), shards=4).collect(), 4)
    check(odd_rows, sharding.shard_documents(make_docs(odd_rows), shards=4, parts=1).collect(), 4)


def test_even_bytes_beside_a_hot_group(make_docs):
    draw = random.Random(8)
    rows = [(i, "z" * draw.randint(0, 300)) for i in range(2000)] + [(5000 + i, "copy") for i in range(700)]
    got = sharding.shard_documents(make_docs(rows)).collect()
    check(rows, got, 16)
    load = [0] * 16
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load) <= 1.02 * sum(load) / 16


def test_best_fit_decreasing_is_plain_best_fit():
    draw = random.Random(9)
    for _ in range(30):
        items = sorted(((draw.randint(1, 50), i) for i in range(draw.randint(1, 80))), reverse=True)
        capacity = draw.randint(50, 120)
        bins, want = [], []
        for size, _ in items:
            fits = sorted((left, i) for i, left in enumerate(bins) if left >= size)
            at = fits[0][1] if fits else len(bins)
            if not fits:
                bins.append(capacity)
            bins[at] -= size
            want.append(at)
        assert sharding.best_fit_decreasing(items, capacity) == want
    assert sharding.best_fit_decreasing([(9, 0)], 8) is None


def test_empty(make_docs):
    assert sharding.shard_documents(make_docs([])).count() == 0
    assert sharding.shard_documents(make_docs([(None, None)])).collect()[0]["slot"] == 0
