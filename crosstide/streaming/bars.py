"""Price bars from a stream of trades, for panels that grow by the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(trades: DataFrame, every: str = "1 day", late: str = "1 day", time: str = "ts", ticker: str = "ticker", price: str = "price", size: str = "size") -> DataFrame:
    """date, ticker, open, high, low, close, volume of each window; works on streams and tables alike.

    A stream's state is bounded by the watermark: trades later than `late` are left out, and in append mode a window
    comes out once the watermark has passed it.
    """
    t, p = F.col(time), F.col(price)
    rows = trades.withWatermark(time, late) if trades.isStreaming else trades
    found = rows.groupBy(F.window(t, every).alias("w"), F.col(ticker).cast("string").alias("ticker")).agg(
        F.min_by(p, F.struct(t, p)).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, F.struct(t, p)).alias("close"), F.sum(size).cast("double").alias("volume")
    )
    return found.select(F.to_date("w.start").alias("date"), "ticker", "open", "high", "low", "close", "volume")
