"""Quotas of strata whose shares end in a half."""

import duckdb

from hyperslice.operators import splits
from hyperslice.plans import queries


def test_halves_round_to_even_as_in_sql(spark, tmp_path):
    """45 * 0.7 is 31.49... in doubles, but 31.5 in decimals: every stratum size up to 120 against the SQL."""
    spark.sql("select concat('l', n) lang, 's' source from (select explode(sequence(1, 120)) n) lateral view explode(sequence(1, n)) as i").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.split_targets_strength(spark, str(tmp_path)).select("stratum", "n", "n_train", "n_val", "n_test").collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select stratum, n, n_train, n_val, n_test from ({queries.SQL['split_targets_strength']})").fetchall()
    assert got == set(want) and ("l45|s", 45, 32, 4, 9) in got


def test_other_shares_are_exact_too(spark):
    row = splits.quota_targets(spark.range(65).selectExpr("'x' as lang"), "lang", 0.3, 0.1).first()
    assert (row["n_train"], row["n_val"]) == (20, 6)  # 19.5 and 6.5
