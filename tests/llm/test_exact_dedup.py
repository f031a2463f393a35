import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from joinwright.llm.exact_dedup import DigestIndex, drop_exact_duplicates, exact_duplicates
from joinwright.llm.filters import build_filter, maybe_in
from joinwright.llm.workspace import Workspace

ROWS = [(5, "a"), (3, "a"), (8, "a"), (1, "b"), (2, None), (4, ""), (6, "A"), (7, "a "), (9, "x" * 200_000), (10, "x" * 200_000), (11, "é"), (12, "é")]


def brute(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (best(v), len(v), i == best(v), hashlib.sha256(t.encode()).digest()) for t, v in groups.items() for i in v}


def as_dict(df):
    return {r.id: (r.keep_id, r.group_size, r.kept, bytes(r.sha)) for r in df.collect()}


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("digest_bytes,memtable_rows", [(32, 1 << 24), (1, 1 << 24), (32, 50), (1, 100)])
def test_against_brute_force_also_with_colliding_digests(spark, keep, best, digest_bytes, memtable_rows):
    more = ROWS + [(100 + i, f"text {i % 300}") for i in range(600)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in more], "doc_id long, text string, digest string, id int")
    assert as_dict(exact_duplicates(docs, keep=keep, digest_bytes=digest_bytes, memtable_rows=memtable_rows)) == brute(more, best)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (None, "a", 2), (None, "c", 3), (None, "c", 4), (2, "z", 5), (1, "q", 6)], "doc_id long, text string, extra int")
    found = exact_duplicates(docs).collect()
    assert len(found) == 7 and sum(r.kept for r in found) == 4
    assert sorted((r.keep_id or 0, r.group_size) for r in found) == [(0, 2), (0, 2), (1, 1), (1, 3), (1, 3), (1, 3), (2, 1)]
    kept = drop_exact_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "a"), ("1", "q"), ("2", "z"), ("None", "c")]
    assert exact_duplicates(docs.limit(0)).count() == 0 and drop_exact_duplicates(docs.limit(0)).count() == 0


def test_dropping_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in ROWS], "doc_id long, text string, maybe int").withColumn("doc", F.lit(1)).withColumn("chunk", F.lit(2))
    kept = drop_exact_duplicates(docs, keep="largest")
    assert kept.columns == docs.columns
    want = brute(ROWS, max)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_batches_merge(spark):
    index = DigestIndex(Workspace(spark, "test"), "smallest")
    for part in (ROWS[:4], ROWS[4:9], ROWS[9:]):
        index.flush(spark.createDataFrame(part, "doc_id long, text string"))
    assert len(index.runs) == 3
    plans = []

    def kept(entries, write=index._sorted_run):
        plans.append(entries._jdf.queryExecution().executedPlan().toString())
        return write(entries)

    index._sorted_run = kept
    index.compact()
    assert as_dict(index.lookup()) == brute(ROWS, min)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Exchange" not in p and " Sort " not in p for p in plans), plans
    run = index.runs[0].collect()
    assert len({r.key for r in run}) == len(run) and not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]
    with pytest.raises(ValueError):
        DigestIndex(Workspace(spark, "test"), "first")


def test_filter_has_no_false_negative(spark):
    keys = spark.range(5000).selectExpr("cast(id * 3 as string) as k")
    chunks, bits = build_filter(keys, "k", 5000)
    rows = maybe_in(spark.range(15000).selectExpr("cast(id as string) as k"), F.col("k"), chunks, bits).collect()
    passed = {int(r.k) for r in rows if r.maybe}
    assert {3 * i for i in range(5000)} <= passed and len(passed) < 6500
