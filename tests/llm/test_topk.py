import math

import numpy as np
from pyspark.sql import functions as F

from joinwright.llm.topk import GROUP, QUERY_GROUP, SortedBlock, _groups, search_block, top_k


def brute(rows, is_query, k=5):
    ok = {}
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in good:
        if is_query(i):
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            ok[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return {i: v for i, v in ok.items() if v}


def test_against_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=8) / 3]) for i in range(700)]
    rows += [(700 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [1.0, float("inf")] + [0.0] * 6), (1200, [1.0, 2.0]), (1201, [3.0, -2.0]), (1250, []), (1251, []), (1300, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, i, "clash") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = {}
    for r in top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute(rows, lambda i: i % 50 == 0)


def best_of(x, ids, q, own, k=5):
    whole = (x @ q).astype(object)
    order = sorted((i for i in range(len(x)) if ids[i] != own), key=lambda i: (-whole[i], ids[i]))[:k]
    return order, [int(whole[i]) for i in order]


def test_skewed_blocks_stop_early_and_stay_exact():
    draw = np.random.default_rng(4)
    x = np.floor(256 * draw.normal(size=(3000, 6)) * draw.pareto(1.2, size=(3000, 1)))
    q = np.floor(256 * draw.normal(size=(20, 6)))
    ids, own = np.arange(3000), np.arange(20)
    block, depths = SortedBlock(x, ids), []
    for j, places, scores, depth in search_block(block, q, own, 5):
        assert (places.tolist(), scores) == best_of(x, ids, q[j], own[j])
        depths.append(depth)
    assert len(depths) == 20 and max(depths) < 3000 and np.median(depths) <= 256


def test_what_is_known_of_other_blocks_stops_reading():
    draw = np.random.default_rng(5)
    x, q = np.floor(256 * draw.normal(size=(2000, 12))), np.floor(256 * draw.normal(size=(10, 12)))
    block, ids, own = SortedBlock(x, np.arange(2000)), np.arange(2000), np.full(10, -1)
    alone = {j: d for j, _, _, d in search_block(block, q, own, 5)}
    known = np.array([1.5 * best_of(x, ids, v, -1)[1][0] for v in q])
    found = list(search_block(block, q, own, 5, known))
    assert len(found) == 10
    assert all(d <= alone[j] for j, _, _, d in found) and min(d for _, _, _, d in found) < min(alone.values())


def test_ties_and_repeated_rows(spark):
    rows = [(i % 300, [float(i % 3), 1.0, -0.5]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in top_k(df, F.col("vec_id") == 50, k=4).collect():
        found.setdefault(r["rank"], []).append((r.id, r.score))
    candidates = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, rows[50][1])), i) for i, v in rows if i != 50)
    assert found == {k + 1: [(i, -s)] * 3 for k, (s, i) in enumerate(candidates[:4])}


def test_groups_are_bounded_and_use_the_cores():
    for asked, blocks, cores in ((1, 1, 32), (5, 13, 24), (1000, 20_000, 24), (0, 0, 8), (3, 400, 4000)):
        g, h = _groups(asked, blocks, cores)
        assert asked <= g * QUERY_GROUP and blocks <= h * GROUP and g <= max(1, asked) and h <= max(1, blocks)
        assert g * h >= min(cores, max(1, asked) * max(1, blocks))


def test_large_components_few_rows_and_empty_tables(spark):
    rows = [(0, [1e300, 1.0]), (50, [1e15, -1e15]), (51, [2.0**40, 3.0]), (None, [1.0, 1.0]), (100, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(df, F.col("vec_id") % 50 == 0).collect()
    want = {}
    for i, v in rows:
        if i is not None and i % 50 == 0:
            scores = [(-min(max(sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), -(2**63)), 2**63 - 1), j is None, j or 0) for j, w in rows if j != i]
            want |= {(i, k + 1): ((None if n else j), -s) for k, (s, n, j) in enumerate(sorted(scores))}
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in found} == want and len(want) == 12
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
