"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from cellmart.plans import catalogue
from tests.conftest import SF


def osa_within(a: str, b: str, most: int) -> bool:
    """Optimal string alignment: whether at most so many insertions, deletions, changes and swaps of neighbours lead from a to b."""
    if abs(len(a) - len(b)) > most:
        return False
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SF}/{t}')")
    return c


def norm(df):
    def one(v):
        if pd.isna(v):
            return ""
        return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_geocode_job_against_every_pair(spark, tmp_path):
    cities = ("BUILDING", "BUILDINGS", "MACHINERY")
    c = pd.DataFrame({"c_custkey": range(1, 91), "c_mktsegment": [cities[i * i % 3 if i != 14 else 0] for i in range(1, 91)]})
    spark.createDataFrame(c).write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.source_incident_id: (round(r.longitude, 6), round(r.latitude, 6)) for r in catalogue.queries()["geocode_job"](spark, str(tmp_path)).collect()}
    city, want = dict(zip(c.c_custkey, c.c_mktsegment)), {}
    for k in city:
        n = k if k % 2 else k // 2
        same, near = city[n] == city[k], osa_within(city[n], city[k], 1)
        if (n, city[k]) != (7, "BUILDING") and (n % 2 == 0 or near):
            want[f"i{k}"] = (-87.5, round(40 + n / 100, 6))
    assert got == want and any(int(i[1:]) > 60 for i in got) and "i14" not in got
