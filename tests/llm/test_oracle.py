import duckdb

from sorrel.llm import queries

SF = "/root/testdata/sf0.01"


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, cur = queries.queries()[name](spark, SF), con.execute(sql)
        names, want = [c[0] for c in cur.description], cur.fetchall()
        order = sorted(names)
        assert sorted(df.columns) == order
        assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in order) for r in want)
