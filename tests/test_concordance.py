"""Equal effects in the concordance: average ranks, or the least as in the query's SQL."""

from __future__ import annotations

import duckdb
import pytest

from voxcohort.operators import ranks
from voxcohort.plans import registry


def test_equal_effects_share_a_rank(spark):
    data = [("a", 0.0, 3.0), ("b", 0.0, 1.0), ("c", 0.2, 2.0), ("d", 0.5, 5.0)]
    stats = spark.createDataFrame([r[:2] for r in data], "feature string, eta_squared double")
    score = spark.createDataFrame([(r[0], r[2]) for r in data], "feature string, score double")
    con = duckdb.connect()
    con.execute("CREATE TABLE b (f VARCHAR, e DOUBLE, s DOUBLE)")
    con.executemany("INSERT INTO b VALUES (?, ?, ?)", data)
    least = con.sql("SELECT corr(x, y) FROM (SELECT rank() OVER (ORDER BY e) AS x, rank() OVER (ORDER BY s) AS y FROM b)").fetchall()[0][0]
    rho = {t: {r.spearman_rho for r in ranks.concordance(stats, score, score="score", ties=t).collect()} for t in ("average", "least")}
    assert [*rho["least"]] == [pytest.approx(least)]
    assert [*rho["average"]] == [pytest.approx(3 / 22.5**0.5)]


def test_query_with_equal_effects(spark, tmp_path):
    """Values in the same places of every class: all effects are 0 but one."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT ['A', 'N', 'R'][1 + i % 3] AS l_returnflag, (i // 3)::DOUBLE AS l_quantity, (i // 3 * 7 % 20)::DOUBLE AS l_extendedprice, (i // 3 % 5)::DOUBLE AS l_discount, i::DOUBLE * (i % 3) AS l_tax
      FROM range(60) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = registry.QUERIES["concordance"](spark, str(tmp_path))
    want = con.sql(registry.ORACLES["concordance"]).fetchall()
    assert sum(r[1] == 0 for r in want) == 3
    assert sorted(tuple(r) for r in got.collect()) == [pytest.approx(r) for r in sorted(want)]
