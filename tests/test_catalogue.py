"""Queries whose SQL is written by hand, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from crosstide import catalogue

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["quantile_summary", "quantile_stats", "two_calendars", "risk_portfolio", "risk_one_factor", "risk_exposures"])
def test_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALLEST).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    ours, theirs = catalogue.queries()[name](spark, SMALLEST).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs) > 0

    def sorted_rows(df: pd.DataFrame) -> pd.DataFrame:
        df = df[columns].copy()
        if "date" in columns:
            df["date"] = pd.to_datetime(df["date"]).dt.strftime("%Y-%m-%d")
        keys = [c for c in columns if df[c].dtype == object or pd.api.types.is_string_dtype(df[c]) or c == "bucket"] or columns
        return df.sort_values(keys).reset_index(drop=True)

    pd.testing.assert_frame_equal(sorted_rows(ours), sorted_rows(theirs), check_dtype=False)


def test_log_rounds_as_sql_does_next_to_halves(spark):
    """Logarithms a hair below or on a half of the sixth digit: Spark's own rounding gave 1.000003 for the first."""
    import math

    sql = catalogue.oracle_sql()["log"].split("FROM (", 1)[0].replace("date, ticker, ", "").strip()
    con = duckdb.connect()
    values = [k + h for k in (1.0, 5.0, 7.0) for h in [(j + 0.5) / 1e6 for j in range(2000)]] + [-math.inf, None]
    theirs = [con.execute(f"{sql} FROM (SELECT ?::DOUBLE AS value)", [v]).fetchone()[0] for v in values]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, value double")
    ours = [r.value for r in frame.select("k", catalogue.rounded("value")).orderBy("k").collect()]
    assert theirs[2] == 1.000002 and ours == theirs
