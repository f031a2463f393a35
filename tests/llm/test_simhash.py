import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from joinwright.llm.components import connected_components
from joinwright.llm.simhash import SMALL, _squares, compare_tiles, fingerprint, hex_fingerprint, keep_one_of_each, near_duplicates, shingle_hashes, tile_order
from joinwright.llm.workspace import Workspace

BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion in the old tower by the river"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(fps):
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    return roots(pairs, fps)


def test_fingerprint_is_the_majority_of_bits():
    for text in (None, "", " \t\n", "one", "A b", "a b c", "a b c d", "É É é x\x1cb y z w", BASE, BASE * 40, "x " * 5000):
        assert fingerprint(shingle_hashes(text, 4, 42)) == brute_fingerprint(text)


def test_components_against_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(4000))
    texts = [None, "", "  ", "one two", "One  TWO", BASE, BASE.upper(), BASE + " again", long, long + " end", "start " + long, "lone text of its own", "x" * 100_000]
    rows = [(i * 7 % 31, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, id long")
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(fps)
    assert {r.id: (r.fp % 2**64, r.component) for r in found} == {k: (fps[k], want[k]) for k in fps}
    assert want[0] == want[7] == want[14]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, BASE), (4, BASE), (4, BASE), (9, BASE + " x"), (None, "other words stand here")], "doc_id long, text string")
    found = near_duplicates(docs).collect()
    assert len(found) == 5
    near = (brute_fingerprint(BASE) ^ brute_fingerprint(BASE + " x")).bit_count() <= 4
    assert sorted((str(r.id), str(r.component)) for r in found) == sorted([("None", "4"), ("4", "4"), ("4", "4"), ("9", "4" if near else "9"), ("None", "None")])
    assert near_duplicates(docs.limit(0)).count() == 0
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string, extra int")).count() == 0
    kept = sorted(str(r.doc_id) for r in keep_one_of_each(docs).collect())
    assert kept == sorted(["None", "None", "4", "4"] + ["9"] * (not near))


def test_clashing_columns_are_kept(spark):
    rows = [(1, BASE, 1, "c", True, 5), (2, BASE, 2, "d", False, 6), (3, "a text of its own that is unlike the others", 3, "e", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, chunk string, maybe boolean, fp int")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_squares_hold_each_pair_of_tiles_once():
    bounds = [(k // 3, k // 3 + 1) for k in range(61)]
    want = {(a, b) for a in range(61) for b in range(a, 61) if bounds[b][0] - bounds[a][1] <= 4}
    for cores in (1, 40, 10_000):
        side, squares = _squares(bounds, 4, cores)
        held = [(a, b) for p, q in squares for a in range(p * side, min(61, p * side + side)) for b in range(max(a, q * side), min(61, q * side + side))]
        assert len(held) == len(set(held)) and want <= set(held)


def test_one_id_on_two_texts_loses_only_the_copy(spark):
    other = "quite different words are written in this line, which no other text has in common with it"
    docs = spark.createDataFrame([(1, BASE, "a"), (5, BASE, "b"), (5, other, "c"), (7, other, "d"), (8, "a third text that stands alone here", "e")], "doc_id long, text string, row string")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.row) for r in kept.collect()) == [(1, "a"), (5, "c"), (8, "e")]


def test_hex(spark):
    row = spark.createDataFrame([(-1,), (5,)], "fp long").select(hex_fingerprint().alias("h")).collect()
    assert [r.h for r in row] == ["f" * 16, "0" * 15 + "5"]


def test_tiles_lose_no_link_and_forests_connect_the_same():
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)) for c in centres for _ in range(30)]
    fps = np.unique(np.concatenate([centres, np.array(near, np.uint64), rng.integers(0, 2**63, 800, dtype=np.uint64)]))
    one, two = fps[::2], fps[1::2]
    parts = [x[tile_order(x)] for x in (one, two)]
    assert all(sorted(p.tolist()) == sorted(x.tolist()) for p, x in zip(parts, (one, two)))
    edges = []
    for a, b, same in ((parts[0], parts[0], True), (parts[1], parts[1], True), (parts[0], parts[1], False)):
        u, v = compare_tiles(a, b, 4, same)
        assert len(u) < len(a) + len(b)
        edges += list(zip(u.tolist(), v.tolist()))
    assert len(one) > SMALL
    nodes = fps.tolist()
    want = roots([(x, y) for i, x in enumerate(nodes) for y in nodes[i + 1 :] if (x ^ y).bit_count() <= 4], nodes)
    assert roots(edges, nodes) == want


def test_connected_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)] + [(-5, 139)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(Workspace(spark, "test"), df).collect()}
    nodes = {n for e in edges[:-2] + edges[-1:] for n in e} - {300}
    assert got == {n: r for n, r in roots([e for e in edges if e[0] != e[1]], nodes).items()}
    assert connected_components(Workspace(spark, "test"), df.limit(0)).count() == 0
    assert F is not None
