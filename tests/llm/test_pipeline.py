import numpy as np

import corpus_pipeline
from joinwright.llm.queries import GRADE, VOCABULARY
from joinwright.llm.simhash import fingerprint, shingle_hashes
from joinwright.llm.toxicity import train
from joinwright.llm.workspace import table
from tokenizers import Tokenizer


def test_each_stage_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    model = train(docs, table(spark, folder, "labels"), GRADE)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder).cache()
        rows = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            assert {r.doc_id for r in rows} == {i for i, t in before.items() if model.severity(t or "")[0] < model.cut}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i], i)
            assert sorted(r.doc_id for r in rows) == sorted(first.values())
        elif name == "near_dedup":
            fps = {i: fingerprint(shingle_hashes(t, 4, 42)) for i, t in before.items()}
            up = {i: i for i in fps}

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a in fps:
                for b in fps:
                    if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                        x, y = find(a), find(b)
                        up[max(x, y)] = min(x, y)
            assert sorted(r.doc_id for r in rows) == sorted(i for i in fps if find(i) == i)
        elif name == "mixing":
            sizes = {i: len((t or "").split()) for i, t in before.items()}
            taken = sum(sizes[r.doc_id] for r in rows)
            assert abs(taken - 1.5 * sum(sizes.values())) <= 0.03 * 1.5 * sum(sizes.values())
            assert max(np.unique([r.doc_id for r in rows], return_counts=True)[1]) <= 2
            mixed = [r.doc_id for r in rows]
        else:
            library = Tokenizer.from_file(VOCABULARY)
            library.no_truncation()
            assert sorted(r.doc_id for r in rows) == sorted(mixed)
            assert all(r.token_ids == library.encode(before[r.doc_id] or "", add_special_tokens=False).ids for r in rows[:40])
        if name not in ("mixing", "bpe"):
            assert rows
            before = {r.doc_id: r.text for r in rows}


def test_odd_rows_at_each_stage(spark, folder):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " "), (4, long), (5, long), (5, long), (6, "some plain text of a few words stands here"), (None, "a text without an id is not lost on the way"), (None, None)]
    rows = [(i, t, "en", None if k % 2 else "s", 0, "mine", 1.5, k, "c", True) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic string, severity double, id int, chunk string, maybe boolean")
    whole = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, whole.limit(0), folder).count() == 0
        if name == "bpe":
            break
        assert out.columns == whole.columns
        kept = out.collect()
        assert {r.toxic for r in kept} == {"mine"} and {r.severity for r in kept} == {1.5}
        ids = sorted((str(r.doc_id), len(r.text or "")) for r in kept)
        if name == "toxicity":
            assert len(kept) == len(rows)
        elif name == "exact_dedup":
            assert ids == sorted([("1", 0), ("3", 1), ("4", len(long)), ("6", 42), ("None", 43)])
        elif name == "near_dedup":
            assert ids == sorted([("1", 0), ("4", len(long)), ("6", 42), ("None", 43)])
        docs = spark.createDataFrame(kept, whole.schema)
    assert sorted((str(r.doc_id), bool(r.n_tokens)) for r in out.collect()) == sorted((str(r.doc_id), bool(r.text)) for r in kept)


def test_run_is_registered_and_reruns_agree(spark, folder):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    one, two = (sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert one == two and one
