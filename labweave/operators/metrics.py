"""Regression metrics, score summaries and residual tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labweave.functions.cleaning import nan_to_null
from labweave.functions.normal import with_normal_quantile
from labweave.functions.stats import stat, with_stats
from labweave.operators.quantiles import with_global_rank


def regression_metrics(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE and R2, per group when group columns are given; one partial aggregate.

    R2 is null for a constant target.
    """
    y, p = F.col(actual), F.col(predicted)
    both = df.filter(y.isNotNull() & p.isNotNull())
    mse, spread = F.avg((y - p) * (y - p)), F.var_pop(y)
    return both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.when(spread > 0, 1 - mse / spread).alias("r2"),
    )


def score_summary(scores: DataFrame, score: str = "r2", group: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.groupBy(*group).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))


def best_scores(scores: DataFrame, group: Sequence[str], r2: str = "r2", rmse: str = "rmse", at: str = "n_features") -> DataFrame:
    """Best R2 and RMSE per group, ignoring null and NaN, and where the best R2 was reached."""
    clean = scores.withColumns({r2: nan_to_null(F.col(r2)), rmse: nan_to_null(F.col(rmse))})
    return clean.groupBy(*group).agg(
        F.max(r2).alias("best_r2"), F.min(rmse).alias("best_rmse"), F.max_by(at, r2).alias("best_at")
    )


def median_positions(rank: Column, n: Column) -> Column:
    """Filliben's estimate of the order statistic medians."""
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    return F.when(rank == 1, 1 - last).when(rank == n, last).otherwise((rank - 0.3175) / (n + 0.365))


def normal_qq(df: DataFrame, residual: str, key: str) -> DataFrame:
    """``(key, rank, theoretical, ordered)``: residuals against normal quantiles."""
    present = df.select(key, residual).filter(F.col(residual).isNotNull())
    ranked = with_stats(with_global_rank(present, residual, key), present, n=F.count(F.lit(1)))
    return with_normal_quantile(ranked, median_positions(F.col("rank"), stat("n")), "theoretical").select(
        key, "rank", "theoretical", F.col(residual).alias("ordered")
    )


def qq_line(qq: DataFrame) -> DataFrame:
    """Least-squares line and correlation of a Q-Q table; residuals without spread have no correlation (null)."""
    x, y = F.when(F.col("ordered").isNotNull(), F.col("theoretical")), F.when(F.col("theoretical").isNotNull(), F.col("ordered"))
    cov = F.covar_pop("ordered", "theoretical")
    slope = F.try_divide(cov, F.var_pop(x))
    return qq.agg(
        slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"),
        F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)).alias("r"),
    )


def predicted_vs_actual(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Points of the predicted-vs-actual chart with the ends of the identity line."""
    y, p = F.col(actual), F.col(predicted)
    return with_stats(df, df, lo=F.least(F.min(y), F.min(p)), hi=F.greatest(F.max(y), F.max(p))).select(
        *keys, y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"),
        stat("lo").alias("line_lo"), stat("hi").alias("line_hi"),
    )
