"""Sizes in every unit, beside the query's SQL."""

import duckdb

from voicelake.plans import catalog


def test_sizes_up_to_tebibytes_equal_the_sql(spark, tmp_path):
    path = f"{tmp_path}/orders.parquet"
    rows = [(99, 900_000), (98, 120_000), (97, 1_000), (96, 5), (1, 0), (11, 7)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    want = dict(con.execute(catalog.ORACLES["fmt_bytes"]).fetchall())
    got = {r["o_orderkey"]: r["text"] for r in catalog.QUERIES["fmt_bytes"](spark, str(tmp_path)).collect()}
    assert got == want and got[98].endswith("TiB") and got[96] == "2.34 KiB"
