import random
from collections import Counter

from sluice.llm import mixing
from tests.llm import brute


def targets(sizes):
    """Targets by repeated sharing, plainly."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        if not rest:
            return stopped
        level = (budget - sum(stopped.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not above:
            return stopped | {s: weight[s] * level for s in rest}
        stopped |= {s: 3 * sizes[s] for s in above}


def check(rows, got):
    size = Counter()
    for _, t, *more in rows:
        size[(more + [None, None])[1]] += len(brute.words(t))
    want = targets(dict(size))
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= sum(size.values())
    return taken, want


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = mixing.fair_queue(docs).collect()
    check(odd_rows, got)
    again = mixing.fair_queue(docs.repartition(5)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), str(r["source"]), r["taken"]) for r in rows)
    assert key(got) == key(again)


def test_shares_come_near(make_docs):
    draw = random.Random(6)
    rows = [(i, " ".join(["w"] * draw.randint(1, 12)), "en", draw.choice(["hot"] * 5 + ["a", "b", "c", None])) for i in range(3000)]
    rows += [(9000 + i, "x y", "en", "tiny") for i in range(5)]
    taken, want = check(rows, mixing.fair_queue(make_docs(rows)).collect())
    for s in want:
        assert abs(taken[s] - want[s]) <= 13 + 0.01 * want[s]
    assert taken["tiny"] == want["tiny"] == 30  # three times its ten words


def test_rows_of_the_mix(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    often = Counter()
    for r in mixing.fair_queue(docs).collect():
        often[r["doc_id"]] += r["copies"]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in often.items() if v})


def test_empty(make_docs):
    assert mixing.fair_queue(make_docs([])).count() == 0
    assert mixing.mix_documents(make_docs([])).count() == 0
    assert [r["taken"] for r in mixing.fair_queue(make_docs([(1, None), (2, "")])).collect()] == [0, 0]
