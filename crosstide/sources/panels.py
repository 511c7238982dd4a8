"""Panels: long tables with a row for each date and ticker, dense, and what leads to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.kernels import div


def check_unique(df: DataFrame) -> DataFrame:
    """df, or ValueError if a date and ticker occur twice."""
    twice = df.groupBy("date", "ticker").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row for {twice[0].ticker} on {twice[0].date}")
    return df


def densify(df: DataFrame, partitions: int | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Every date of df for every ticker of df, missing cells NULL; dealt by ticker, as the time-series functions need it.

    dates: the dates of df, where they are cheaper to get than from df. The calendar is small, and a row stands for the
    missing dates up to the ticker's next one: no grid is made to be joined.
    """
    calendar = (df if dates is None else dates).select("date").where(F.col("date").isNotNull()).distinct()
    place = F.row_number().over(Window.orderBy("date")).alias("at")
    days = calendar.select("date", place, F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    others = [c for c in df.columns if c not in ("date", "ticker")]
    rows = df.select("ticker", "date", F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.lit(True).alias("there")).alias("row")).join(F.broadcast(days), "date").drop("date")
    dealt = rows.repartition(partitions, "ticker") if partitions else rows.repartition("ticker")
    near = Window.partitionBy("ticker").orderBy("at")
    first = F.lag("at").over(near).isNull()
    after = F.greatest(F.coalesce(F.lead("at").over(near), F.col("n") + 1) - 1, F.col("at"))
    # rows without a ticker are on each date once, and have nothing
    named = F.col("ticker").isNotNull()
    dealt = dealt.withColumns({"from": F.when(first, 1).otherwise(F.col("at")), "to": F.when(named, after).when(first, F.col("n"))}).where("to is not null")
    filled = dealt.select("ticker", F.when(named, F.col("row")).alias("row"), F.col("at").alias("own"), F.explode(F.sequence(F.col("from").cast("int"), F.col("to").cast("int"))).alias("at"))
    cell = lambda k: F.when(F.col("own") == F.col("at"), F.col(f"row.c{k}"))
    return filled.join(F.broadcast(days.select("date", "at")), "at").select("date", "ticker", *[cell(k).alias(c) for k, c in enumerate(others)])


def from_wide(df: DataFrame, date: str = "date") -> DataFrame:
    """A matrix with a column for each ticker as (date, ticker, value)."""
    return df.unpivot([date], [c for c in df.columns if c != date], "ticker", "value").withColumnRenamed(date, "date")


def to_wide(df: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """(date, ticker, value) as a matrix sorted by date; doubled cells are refused. For more tickers than a table can
    have columns (spark.sql.pivotMaxValues) there is to_blocks."""
    grouped = check_unique(df).groupBy("date")
    return (grouped.pivot("ticker", tickers) if tickers else grouped.pivot("ticker")).agg(F.first("value")).orderBy("date")


def to_blocks(df: DataFrame, blocks: int = 1024) -> DataFrame:
    """(date, ticker, value) as a matrix in blocks of columns: date, block, the block's tickers, their values. A row for
    each date and block, so that a matrix may be wider than a table can have columns; doubled cells fail as it is read."""
    cells = densify(df.select("date", "ticker", "value")).select("date", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int").alias("block"), F.struct("ticker", "value").alias("cell"))
    rows = cells.groupBy("date", "block").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    tickers = F.col("cells.ticker")
    checked = F.when(F.size(F.array_distinct(tickers)) == F.size(tickers), tickers).otherwise(F.raise_error(F.concat(F.lit("more than one row for a ticker on "), F.col("date").cast("string"))).cast("array<string>"))
    return rows.select("date", "block", checked.alias("tickers"), F.col("cells.value").alias("values"))


def from_blocks(df: DataFrame) -> DataFrame:
    """A matrix in blocks as (date, ticker, value)."""
    cells = df.select("date", F.explode(F.arrays_zip("tickers", "values")).alias("cell"))
    return cells.select("date", F.col("cell.tickers").alias("ticker"), F.col("cell.values").alias("value"))


def asof_fill(daily: DataFrame, sparse: DataFrame, columns: list[str]) -> DataFrame:
    """daily (date, ticker) with the columns of the last row of sparse on or before each date, missing ones included."""
    keys = daily.select("date", "ticker").withColumn("asked", F.lit(True))
    rows = sparse.select("date", "ticker", F.struct(*columns).alias("row"))
    both = keys.join(rows, ["date", "ticker"], "full_outer")
    seen = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("row", F.last("row", ignorenulls=True).over(seen)).where("asked").select("date", "ticker", *[F.col(f"row.{c}").alias(c) for c in columns])


def with_static(panel: DataFrame, profiles: DataFrame, columns: list[str], most_rows: int = 1_000_000) -> DataFrame:
    """Attributes of tickers on every date; profiles are broadcast only up to most_rows."""
    side = profiles.select("ticker", *columns).dropDuplicates(["ticker"])
    return panel.join(F.broadcast(side) if side.limit(most_rows + 1).count() <= most_rows else side, "ticker", "left")


def ratio(a: str, b: str) -> Column:
    """A derived field, as in book value over price."""
    return div(F.col(a), F.col(b))


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def _quantity() -> Column:
    """Hundredths of a piece."""
    return F.round(F.col("l_quantity") * 100).cast("long")


def _price(cents: Column, quantity: Column) -> Column:
    """Whole cents a piece, rounded down: integers until the last division, so all engines agree to the bit. Nothing for
    no pieces."""
    pieces = F.when(quantity != 0, quantity)
    return (cents * 100 - (cents * 100) % pieces) / pieces / F.lit(100.0)


def supplier_panel(spark, sf_dir: str, grain: str = "week") -> DataFrame:
    """Prices and volumes of suppliers' line items by week or month, with the supplier's region and nation."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    items = read("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("ticker"), _cents().alias("cents"), _quantity().alias("quantity"))
    items = items.withColumn("price", _price(F.col("cents"), F.col("quantity")))
    day = F.to_date(F.date_trunc(grain, "l_shipdate")).alias("date")
    traded = items.groupBy(day, "ticker").agg(
        _price(F.sum("cents"), F.sum("quantity")).alias("close"),
        (F.sum("quantity") / F.lit(100.0)).alias("volume"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.min_by("price", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "price")).alias("open"),
    )
    traded = traded.withColumn("event", F.when(F.col("volume") > 60, F.col("volume") / 10))
    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    profiles = read("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("nation"))
    return with_static(densify(traded, dates=items.select(day)), profiles, ["sector", "nation"])


def _sprice(cents: str, quantity: str) -> str:
    return f"((({cents}) * 100 - (({cents}) * 100) % nullif({quantity}, 0))::DOUBLE / nullif({quantity}, 0)::DOUBLE / 100.0::DOUBLE)"


_CENTS, _QUANTITY = "round(l_extendedprice * 100)::BIGINT", "round(l_quantity * 100)::BIGINT"


def supplier_panel_sql(grain: str = "week") -> str:
    """The same in DuckDB's SQL."""
    return f"""SELECT d.date, t.ticker, close, volume, low, high, open, CASE WHEN volume > 60 THEN volume / 10 END AS event, r_name AS sector, n_name AS nation
FROM (SELECT DISTINCT date_trunc('{grain}', l_shipdate)::DATE AS date FROM lineitem) d CROSS JOIN (SELECT DISTINCT l_suppkey::VARCHAR AS ticker FROM lineitem) t
LEFT JOIN (SELECT date, ticker, {_sprice('sum(cents)', 'sum(quantity)')} AS close, (sum(quantity)::DOUBLE / 100.0::DOUBLE) AS volume, min(price) AS low, max(price) AS high, arg_min(price, {{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': price}}) AS open
  FROM (SELECT *, date_trunc('{grain}', l_shipdate)::DATE AS date, l_suppkey::VARCHAR AS ticker, {_CENTS} AS cents, {_QUANTITY} AS quantity, {_sprice(_CENTS, _QUANTITY)} AS price FROM lineitem) GROUP BY date, ticker) x ON x.date = d.date AND x.ticker = t.ticker
LEFT JOIN supplier ON s_suppkey::VARCHAR = t.ticker LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""


def brand_panel(spark, sf_dir: str, grain: str = "month") -> DataFrame:
    """Prices and volumes of brands' line items, near dense and smoother than a supplier's."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sold = read("lineitem").join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    traded = sold.groupBy(F.to_date(F.date_trunc(grain, "l_shipdate")).alias("date"), F.col("p_brand").alias("ticker")).agg(_price(F.sum(_cents()), F.sum(_quantity())).alias("close"), (F.sum(_quantity()) / F.lit(100.0)).alias("volume"))
    return densify(traded)


def brand_panel_sql(grain: str = "month") -> str:
    return f"""SELECT d.date, t.ticker, close, volume FROM (SELECT DISTINCT date_trunc('{grain}', l_shipdate)::DATE AS date FROM lineitem) d CROSS JOIN (SELECT DISTINCT p_brand AS ticker FROM lineitem JOIN part ON l_partkey = p_partkey) t
LEFT JOIN (SELECT date_trunc('{grain}', l_shipdate)::DATE AS date, p_brand AS ticker, {_sprice(f'sum({_CENTS})', f'sum({_QUANTITY})')} AS close, (sum({_QUANTITY})::DOUBLE / 100.0::DOUBLE) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) x ON x.date = d.date AND x.ticker = t.ticker"""
