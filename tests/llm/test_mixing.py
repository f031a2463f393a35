from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from joinwright.llm import mixing
from joinwright.llm.mixing import Mixture, _leaves, affine, split_quotas, targets


def test_targets_fill_up_by_weight():
    got = targets({"a": 100, "b": 100, None: 10, "B": 1000}, (5, 2, 1), 1.5, 2.0)
    # order: B (5), a (2), b (1), null (5)
    assert got[None] == 20.0 and got["a"] == 200.0
    assert abs(sum(got.values()) - 1.5 * 1210) < 1e-6
    assert abs(got["B"] / got["b"] - 5) < 1e-9 or got["B"] == 2000.0 or got["b"] == 200.0
    assert all(v <= 2 * s + 1e-9 for v, s in zip([got["a"], got["b"], got[None], got["B"]], [100, 100, 10, 1000]))
    assert targets({}, (1,), 1.5, 2.0) == {} and targets({"x": 0}, (1,), 1.5, 2.0) == {"x": 0.0}


def test_splitting_tree_keeps_quotas_and_is_even():
    quotas = np.array([1000, 37, 0, 5])

    def grid(seed, stop=1):
        out, spans = np.zeros((13, 4), np.int64), [[] for _ in quotas]
        for first, n, source, start, here in split_quotas(quotas, 13, seed, stop=stop):
            out[first, source] += here
            for s, a, q in zip(source.tolist(), start.tolist(), here.tolist()):
                spans[s] += range(a, a + q)
        assert [sorted(s) for s in spans] == [list(range(q)) for q in quotas]
        return out

    out = grid(3)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all()
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 13
    assert (out == grid(3)).all() and not (out == grid(4)).all()
    grid(3, stop=4)


def test_a_subtree_draws_what_the_whole_tree_draws():
    quotas = np.array([500, 300, 41])
    whole = {n: (source.tolist(), start.tolist(), here.tolist()) for n, _, source, start, here in split_quotas(quotas, 21, 5)}
    for first, n, source, start, here in split_quotas(quotas, 21, 5, stop=4):
        frame = pd.DataFrame({"first": [first], "shards": [n], "sids": [source], "starts": [start], "quotas": [here]})
        for leaf in _leaves(iter([frame]), 5):
            assert (leaf["sid"].tolist(), leaf["start"].tolist(), leaf["n"].tolist()) == whole.pop(int(leaf["shard"].iloc[0]))
    assert not whole


def test_affine_orders_are_permutations():
    for blocks in (1, 2, 7, 64, 1000):
        a, o, back = affine(blocks, 42, "s", 1)
        places = [(a * b + o) % blocks for b in range(blocks)]
        assert sorted(places) == list(range(blocks)) and [(p - o) * back % blocks for p in places] == list(range(blocks))


def documents(n=3000):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), ["s1", "s2", "S", None, "hot"][min(i % 9, 4)]) for i in range(n)]
    return rows + [(n, None, "s1"), (n + 1, "  \t", "s2"), (n + 2, "w " * 20_000, "hot"), (n + 3, "", "empty")]


def water(sizes):
    """Targets by bisection of the level that weights are multiplied by."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high, want = 0.0, 2.0 * sum(sizes.values()) + 1, 1.5 * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in names) < want else (low, level)
    return {s: min(2.0 * sizes[s], high * weight[s]) for s in names}


def test_taken_words_come_near_targets(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, block string")
    mix = Mixture(docs, shards=8)
    found = mix.taken().collect()
    assert len(found) == len(rows)
    source = {i: s for i, _, s in rows}
    words = {i: len((t or "").split()) for i, t, _ in rows}
    total, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert r.size == words[r.id] and r.taken == r.size * r.copies <= 2 * r.size and len(r.shards) == r.copies
        total[source[r.id]] += r.size
        taken[source[r.id]] += r.taken
        goal[source[r.id]] = r.target
    assert goal == pytest.approx(water(dict(total)))
    assert all(r.source_size == total[source[r.id]] for r in found)
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(0.001 * g, 2), (s, taken[s], g)
    again = {r.id: (r.taken, list(r.shards)) for r in Mixture(docs.repartition(7), shards=8).taken().collect()}
    assert again == {r.id: (r.taken, list(r.shards)) for r in found}
    load = defaultdict(int)
    for r in found:
        for s in r.shards:
            load[s] += 1
    assert set(load) == set(range(8)) and max(load.values()) < 2 * min(load.values())
    mixed = mix.mixed()
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r.id: r.copies for r in found if r.copies}


def test_small_sources_close_their_gap(spark):  # of some 58 rows each, one of which is about 2 % of a target
    draw = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(draw.integers(1, 900))), f"s{i % 12}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, goal = defaultdict(int), {}
    size = {i: len(t.split()) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    for r in Mixture(docs).taken().collect():
        s = f"s{r.id % 12}"
        assert r.size == size[r.id] and r.taken in (0, r.size, 2 * r.size) and r.source_size == total[s]
        taken[s] += r.taken
        goal[s] = r.target
    assert goal == pytest.approx(water(dict(total)))
    assert max(abs(taken[s] / g - 1) for s, g in goal.items()) <= 0.02, sorted(taken[s] / g for s, g in goal.items())


def test_bounds_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(documents(1500), "doc_id long, text string, source string")
    one = {r.id: (r.taken, r.shards) for r in Mixture(docs, shards=6).taken().collect()}
    for k, v in {"BROADCAST_SOURCES": 2, "BROADCAST_ROWS": 3, "STRETCH": 4, "SUBTREES": 2}.items():
        monkeypatch.setattr(mixing, k, v)
    mix = Mixture(docs, shards=6)
    assert {r.id: (r.taken, r.shards) for r in mix.taken().collect()} == one
    assert sum(len((r.text or "").split()) for r in mix.mixed().collect()) == sum(t for t, _ in one.values())


def test_every_shard_is_one_partition(spark):
    docs = spark.createDataFrame(documents(1500), "doc_id long, text string, source string")
    mix = Mixture(docs, shards=6)
    want = defaultdict(list)
    for r in mix.taken().collect():
        for s in r.shards:
            want[s].append(r.id)
    got = mix.mixed().rdd.mapPartitionsWithIndex(lambda k, rows: [(k, [r.doc_id for r in rows])]).collect()
    assert {k: sorted(v) for k, v in got} == {k: sorted(want[k]) for k in range(6)}
    assert any(v != sorted(v) for _, v in got)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", None), (None, "c", "s")], "doc_id long, text string, source string")
    found = Mixture(docs, shards=2).taken().collect()
    assert len(found) == 4
    assert Mixture(docs, shards=2).mixed().count() == sum(r.copies for r in found)
    empty = Mixture(docs.limit(0), shards=2)
    assert empty.taken().count() == 0 and empty.mixed().count() == 0
