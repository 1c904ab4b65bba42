"""Registry checks, and every native query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tokenweir.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or type(v).__name__ in ("NAType", "NaTType"):
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        v = float(f"{v:.9g}")
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    return v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(norm(x) for x in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_oracles_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.ORACLES) > 80


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = sql.sql(catalog.ORACLES[name]).to_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_structured_segment_equals_sql_on_odd_texts(spark, tmp_path):
    tables = ["a,b\nc,d\ne,f", "0,\n0;\n0 0", "0\n1\n2", "a\tb\r\nc\td\r\ne\tf\r\n", "a|b\nc|d\ne|f\nx", "a;b\n\n \nc;d\ne f\ng", "7,0\n7,0,1\n7,0,2,2"]
    json = ["[1]", "[1] see", "[1]]", "[1],[2]", '{"a":1}}', "{'a':1}", '{"a":1,"a":2}', '["x\ny"]', '["\x01"]', "[1,2 , ]", "[,]", '{"a":1,}', "[-inf,NaN]", "[+1]", "[1]//", '["\\ud83d\\ude00"]', '["\\ud800"]']
    json += ['["\\x"]', '["a\\"},{"]', "[nan x]", "[1 2]", "[" * 1500 + "]" * 1500, "[" + "9" * 2000 + "]", '{},"z":1}', '{}],"z":1}']
    blanks = [None, "", " \n", "\x0bk:v\n\x0bj:v\n\x0bl:v", "k:\x0bv\nj: v\nl=v", "x" * 40 + "\x0b" * 12, "x" * 31 + "!" * 9]
    texts = [(6 * i + shape, text) for i, text in enumerate(tables + json + blanks) for shape in range(6)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {r["doc_id"]: r["structured"] for r in catalog.QUERIES["structured_segment"](spark, str(tmp_path)).collect()}
    want = dict(con.sql(catalog.ORACLES["structured_segment"]).fetchall())
    assert got == want
    assert got[0] and not got[6] and not got[12]
