"""A folder of Parquet files, one wide matrix for each field, as source and sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import LazyData
from .panels import from_wide, to_wide

DESCRIPTIONS = "field_descriptions.json"


def _list(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def read_fields(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> LazyData:
    """Every NAME.parquet as field NAME, read on first use; descriptions from the folder's JSON file, else defaults."""
    names = _list(spark, path)
    fields = [n.removesuffix(".parquet") for n in names if n.endswith(".parquet")]
    if not fields:
        raise FileNotFoundError(f"no Parquet file in {path}")
    said = dict(defaults or {})
    if DESCRIPTIONS in names:
        said |= json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{DESCRIPTIONS}", wholetext=True).collect()))
    load = lambda n: lambda: _long(spark.read.parquet(f"{path}/{n}.parquet"))
    return LazyData({n: load(n) for n in fields}, {n: said[n] for n in fields if n in said})


def _long(df: DataFrame) -> DataFrame:
    return df if {"ticker", "value"} <= set(df.columns) else from_wide(df, df.columns[0])


def write_fields(fields: dict[str, DataFrame], path: str, descriptions: dict[str, str] | None = None, wide: bool = True) -> None:
    """A matrix for each field (date, ticker, value), and the descriptions of those saved."""
    spark = next(iter(fields.values())).sparkSession
    for name, df in fields.items():
        (to_wide(df) if wide else df).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    text = json.dumps({k: v for k, v in (descriptions or {}).items() if k in fields}, indent=1)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DESCRIPTIONS}")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def panel_field(panel: DataFrame, name: str) -> DataFrame:
    """One field of a panel as (date, ticker, value)."""
    return panel.select("date", "ticker", F.col(f"`{name}`").alias("value"))
