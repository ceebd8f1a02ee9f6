"""Time-series feature table.

Rows are ranked within each series by (order, id) with ``range_rank``; lags
and the rolling frame are then computed inside blocks of consecutive ranks
that carry a halo of the previous block's last rows, so no window partition
is larger than one block, whatever the series skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import calendar_parts
from tessera.operators.ordering import block_windows, range_rank


def ts_features(df: DataFrame, order_col: str, target: str, id_col: str, horizon: int = 1,
                series_cols=(), with_calendar: bool = True, drop_incomplete: bool = True,
                block: int = 100_000) -> DataFrame:
    """I12 + J01 (lags h..h+4) + J02/J03 (mean and sample std of the three
    values ending h steps back, null until the frame is full) + B15."""
    series = list(series_cols)
    h = int(horizon)
    d = df.withColumn(target, F.col(target).cast("string").try_cast("double")) \
        if not dict(df.dtypes)[target] in ("double", "float", "int", "bigint", "smallint", "tinyint") else df
    if with_calendar:
        d = d.withColumns({k: v for k, v in calendar_parts(order_col).items()})
    d = range_rank(d, [order_col, id_col], series, name="_rk")
    halo = h + 4
    d = block_windows(d, series, "_rk", halo=halo, block=block)
    w = Window.partitionBy(*series, "_blk").orderBy("_rk")
    cols = {}
    for i in range(h, h + 5):
        cols[f"lag_{i}"] = F.lag(target, i).over(w)
    frame = w.rowsBetween(-(h + 2), -h)
    full = F.count(target).over(frame) == 3
    cols[f"rolling_mean_{h}"] = F.when(full, F.avg(target).over(frame))
    cols[f"rolling_std_{h}"] = F.when(full, F.stddev_samp(target).over(frame))
    d = d.withColumns(cols).where(~F.col("_halo")).drop("_blk", "_halo", "_rk")
    if drop_incomplete:
        d = d.dropna("any")
    return d
