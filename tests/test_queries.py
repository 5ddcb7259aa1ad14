"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from boxwise.functions import stats
from boxwise.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    show = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([show(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else show(v) for v in row] for row in df.astype(object).itertuples(index=False))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, duck, name):
    compare(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_models_of_the_queries_hold_their_bounds(spark):
    """The fitted models on the query's own data, where SQL has no form for them."""
    sf = "/root/testdata/sf0.01"
    rows = {name: QUERIES[name](spark, sf).collect() for name in ("dae_fit", "sdae_fit", "gbt_rounds", "gp_kernels", "linear_fit", "forest_fit", "gbt_fit")}
    errors = [r["error"] for r in sorted(rows["dae_fit"], key=lambda r: r["epoch"])]
    assert all(b < a for a, b in zip(errors, errors[1:], strict=False))
    deep, plain = (next(r for r in rows["sdae_fit"] if r["kind"] == k) for k in ("stacked", "softmax"))
    assert deep["test"] == plain["test"] > 2000 and deep["error"] < 0.9 * plain["error"]
    rounds = sorted(rows["gbt_rounds"], key=lambda r: r["round"])
    assert [r["chosen"] for r in rounds] == [False] * (len(rounds) - 1) + [True] and len(rounds) < 25 and rounds[-1]["valid_error"] <= rounds[0]["valid_error"]
    assert len(rows["gp_kernels"]) == 25 and all(r["evidence"] >= r["evidence_at_start"] and r["sampled"] == min(150, r["rows"]) for r in rows["gp_kernels"])
    # quantities are drawn at random, so no model does better than their variance, and none may do much worse
    for name in ("linear_fit", "forest_fit", "gbt_fit"):
        assert rows[name][0]["train"] > rows[name][0]["test"] > 2000 and -0.1 < rows[name][0]["r2"] < 0.1


def test_linear_fit_is_the_direct_elastic_net_solution(spark, sf_dir):
    """Coordinate descent on the same rows in numpy gives the same error on the test part."""
    import numpy as np

    from boxwise.operators import ml
    from boxwise.plans.models import _training

    columns = ["qty_season", "qty_last", "qty_trend", "lines_last"]
    train, _, test = (part.fillna(0.0, columns).toPandas() for part in ml.split(_training(spark, sf_dir), "game"))
    x, y = train[columns].to_numpy(float), train["label"].to_numpy(float)
    spread = x.std(0, ddof=1)
    z, scale = (x - x.mean(0)) / np.where(spread > 0, spread, 1), y.std(ddof=1)
    goal, w = (y - y.mean()) / scale, np.zeros(len(columns))
    penalty = 0.01 / scale  # the penalty is on the scale of the label
    for _ in range(5000):
        for j in range(len(columns)):
            rest = goal - z @ w + z[:, j] * w[j]
            rho, power = z[:, j] @ rest / len(y), z[:, j] @ z[:, j] / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.5 * penalty, 0) / (power + 0.5 * penalty)
    at = (test[columns].to_numpy(float) - x.mean(0)) / np.where(spread > 0, spread, 1)
    mse = np.mean((test["label"].to_numpy(float) - (y.mean() + scale * (at @ w))) ** 2)
    got = QUERIES["linear_fit"](spark, sf_dir).first()
    assert (got["train"], got["test"]) == (len(train), len(test)) and got["mse"] == pytest.approx(mse, rel=2e-3)


def test_typical_deviation_of_odd_quantities_is_numpys(spark, tmp_path):
    inf = float("inf")
    held = {1: [3.0], 2: [3.0, 8.0], 3: [5.0, 1.0, 2.0, 2.0], 4: [None, 4.0, 9.0, 1.0], 5: [None], 6: [inf, 1.0, 2.0], 7: [inf, inf, 1.0], 8: [1.0, 1.7e308, 1.7e308, inf], 9: [0.0, -0.0, -2.5], 10: [float(k * k % 17) for k in range(40)]}
    orders = [(c * 100 + k, c, q) for c, values in held.items() for k, q in enumerate(values)] + [(9901, None, 1.0), (9902, 77, 1.0)]
    df = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, l_quantity double")
    df.selectExpr("o_orderkey", "o_custkey", "timestamp'2020-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority", "1.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    df.selectExpr("o_orderkey AS l_orderkey", "l_quantity", "1.0D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(c, 1, "BUILDING") for c in held], "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["entity"]: r["spread"] for r in QUERIES["typical_deviation"](spark, str(tmp_path)).collect()}
    with np.errstate(all="ignore"):
        there = {c: np.array([q for q in values if q is not None]) for c, values in held.items()}
        want = {c: float(np.median(np.abs(x - np.median(x)))) for c, x in there.items() if len(x)}
    assert got == {c: None if np.isnan(v) else pytest.approx(v, abs=1e-4) for c, v in want.items()}
    assert got[7] is None and got[8] is None and got[6] == 1.0 and 5 not in got


def test_typical_deviation_leaves_numpys_median(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(stats, "of_values", lambda f: seen.append(f) or F.max)
    QUERIES["typical_deviation"](spark, sf_dir)
    monkeypatch.setattr(np, "median", None)  # many small groups pay for its checks
    assert seen[0](np.array([1.0, 5.0, 2.0, 9.0])) == 2.0 and seen[0](np.array([])) is None
