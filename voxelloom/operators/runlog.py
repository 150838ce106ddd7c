"""Analytics over epoch logs.  A run has one row per epoch, so runs are short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_best(metrics: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """Best loss so far, whether the epoch improved it, epochs since improvement.

    An epoch improves when its loss is below the best minus ``min_delta``.
    """
    step = (
        "transform(array(struct(e.val_loss < s.best - {d} as improved)), i -> struct("
        "if(i.improved, e.val_loss, s.best) as best, if(i.improved, 0, s.stale + 1) as stale, "
        "concat(s.trail, array(struct(e.epoch as epoch, e.val_loss as val_loss, "
        "if(i.improved, e.val_loss, s.best) as best_val_loss, i.improved as improved, "
        "if(i.improved, 0, s.stale + 1) as epochs_since))) as trail))[0]"
    ).format(d=f"double('{float(min_delta)!r}')")
    start = (
        "named_struct('best', double('inf'), 'stale', 0, 'trail', cast(array() as array<struct<"
        "epoch:int,val_loss:double,best_val_loss:double,improved:boolean,epochs_since:int>>))"
    )
    epochs = F.sort_array(F.collect_list(F.struct("epoch", F.col("val_loss").cast("double").alias("val_loss"))))
    runs = metrics.groupBy("run_id").agg(epochs.alias("epochs"))
    trail = F.expr(f"aggregate(epochs, {start}, (s, e) -> {step}, s -> s.trail)")
    return runs.select("run_id", F.inline(trail))


def early_stop_epoch(metrics: DataFrame, patience: int = 8, min_delta: float = 0.0) -> DataFrame:
    """First epoch per run with ``patience`` epochs since the last improvement; NULL if never."""
    hit = F.when(F.col("epochs_since") >= patience, F.col("epoch"))
    return mark_best(metrics, min_delta).groupBy("run_id").agg(F.min(hit).alias("stop_epoch"))


def accuracy_forecast(metrics: DataFrame, window: int = 5, horizon: int = 1) -> DataFrame:
    """Linear forecast of the accuracy, clamped to [0, 1]; NULL until the window is full."""
    order = Window.partitionBy("run_id").orderBy("epoch")
    recent = order.rowsBetween(-(window - 1), 0)
    at = metrics.withColumn("_t", F.row_number().over(order).cast("double"))
    y = F.col("d_gan_acc").cast("double")
    slope = F.regr_slope(y, F.col("_t")).over(recent)
    level = F.regr_intercept(y, F.col("_t")).over(recent)
    ahead = F.greatest(F.lit(0.0), F.least(F.lit(1.0), level + slope * (F.col("_t") + horizon)))
    full = F.count(y).over(recent) == window
    return at.withColumn("forecast", F.when(full, ahead)).drop("_t")


def balance_status(forecasts: DataFrame, low: float = 0.6, high: float = 0.8, deadband: float = 0.01) -> DataFrame:
    """Whether the discriminator is too strong or too weak.

    The forecast is used where there is one; only then the deadband narrows
    the target band.
    """
    band = max(0.0, deadband)
    low_in = min(high, low + band)
    high_in = max(low_in, high - band)
    used = F.col("forecast").isNotNull()
    value = F.coalesce("forecast", F.col("d_gan_acc").cast("double"))
    top, bottom = F.when(used, high_in).otherwise(high), F.when(used, low_in).otherwise(low)
    tail = F.when(used, "_pred").otherwise("")
    status = (
        F.when(value > top, F.concat(F.lit("d_strong"), tail))
        .when(value < bottom, F.concat(F.lit("d_weak"), tail))
        .otherwise("hold")
    )
    return forecasts.withColumn("control_acc", value).withColumn("status", status)


def progress_eta(events: DataFrame, elapsed: str = "elapsed_s", done: str = "completed_windows", total: str = "total_windows") -> DataFrame:
    """Rate and remaining seconds of a job."""
    rate = F.col(done) / F.greatest(F.col(elapsed), F.lit(1e-6))
    left = F.greatest(F.col(total) - F.col(done), F.lit(0))
    return events.withColumn("rate", rate).withColumn("eta_seconds", left / F.greatest(rate, F.lit(1e-6)))


def cumulative_examples(metrics: DataFrame) -> DataFrame:
    upto = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return metrics.select(
        "run_id", "epoch", F.col("examples").alias("examples_this_epoch"),
        F.sum("examples").over(upto).alias("cumulative_examples"),
    )
