import math
import os

import duckdb
import pytest

from joinwright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = QUERIES[name](spark, folder)
    names = sorted(df.columns)
    said = con.sql(ORACLES[name])
    assert sorted(said.columns) == names
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    want = sorted(str([plain(r[said.columns.index(c)]) for c in names]) for r in said.fetchall())
    got = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_of_the_whole_table(spark, folder, name):
    if name in ("op6_topk", "op9_chat"):
        return
    rows = QUERIES[name](spark, folder)
    key = "page_id" if "page_id" in rows.columns else "doc_id"
    table = spark.read.parquet(f"{folder}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in table.select(key).collect())
