"""Queries over a training run's step log and its manifest of checkpoints.

A run or a trial may hold much of the table.  Running values therefore come from
bucketed totals, and everything else from aggregates with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators.position import integer_levels, running_totals

# The name pattern and time format of a checkpoint folder.
CHECKPOINT_NAME = r"checkpoint_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}"
CHECKPOINT_TIME = "yyyy-MM-dd_HH-mm-ss"
CHECKPOINT_PREFIX = "checkpoint_"

PARTS = ("has_model", "has_optimizer", "has_schedule", "has_state", "has_config")


def _is_bad(loss: str) -> Column:
    value = F.col(loss)
    return F.isnan(value) | (F.abs(value) == float("inf"))


def with_counters(log: DataFrame, run: str = "run", step: str = "step", batch_size: str = "batch_size") -> DataFrame:
    """``n_batches`` and ``n_examples`` up to and including each step of a run."""
    before = running_totals(
        log,
        {"__batches": F.lit(1), "__examples": F.col(batch_size)},
        [step],
        integer_levels(step),
        within=[run],
    )
    return before.withColumns(
        {"n_batches": F.col("__batches") + 1, "n_examples": F.col("__examples") + F.coalesce(batch_size, F.lit(0))}
    ).drop("__batches", "__examples")


def with_interval_flags(
    counted: DataFrame, log_interval: int, checkpoint_interval: int, step_in_epoch: str | None = None
) -> DataFrame:
    """``should_log`` and ``should_checkpoint``; an interval of -1 turns a flag off.

    With ``step_in_epoch`` (from zero) a checkpoint also needs that step to have
    reached the interval.
    """

    def due(interval: int) -> Column:
        return F.lit(False) if interval == -1 else F.col("n_batches") % interval == 0

    save = due(checkpoint_interval)
    if step_in_epoch is not None and checkpoint_interval != -1:
        save = save & (F.col(step_in_epoch) >= checkpoint_interval)
    return counted.withColumns({"should_log": due(log_interval), "should_checkpoint": save})


def interval_loss(counted: DataFrame, interval: int, run: str = "run", loss: str = "loss") -> DataFrame:
    """Mean loss of each full run of ``interval`` steps."""
    numbered = counted.withColumn("interval_id", F.floor((F.col("n_batches") - 1) / interval))
    means = numbered.groupBy(run, "interval_id").agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("n"))
    return means.filter(F.col("n") == interval).drop("n")


def evaluation_mean(log: DataFrame, loss: str = "loss") -> DataFrame:
    return log.agg(F.avg(loss).alias("eval_loss"), F.count(F.lit(1)).alias("n_steps"))


def throughput(
    log: DataFrame,
    split: str,
    ts: str = "ts",
    samples: str | None = "batch_size",
    tokens: str | None = "n_tokens",
    steps: bool = True,
) -> DataFrame:
    """Runtime per split and what passed per second; a measure not asked for is absent, and null for a split of no
    runtime."""
    runtime = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    totals = [(runtime / 1_000_000).alias("__runtime")]
    rates = []
    for name, total in (
        ("samples", F.sum(samples) if samples else None),
        ("steps", F.count(F.lit(1)) if steps else None),
        ("tokens", F.sum(tokens) if tokens else None),
    ):
        if total is not None:
            totals.append(total.alias(f"__{name}"))
            rates.append(F.round(F.try_divide(f"__{name}", "__runtime"), 5).alias(f"{name}_per_second"))
    return log.groupBy(split).agg(*totals).select(split, F.round("__runtime", 4).alias("runtime"), *rates)


def with_skipped_updates(log: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """``skipped``: an earlier step of the run had a loss that is no number or infinite."""
    bad = F.coalesce(_is_bad(loss), F.lit(False)).cast("int")
    seen = running_totals(log, {"__bad": bad}, [step], integer_levels(step), within=[run])
    return seen.withColumn("skipped", F.col("__bad") > 0).drop("__bad")


def with_validity(manifest: DataFrame) -> DataFrame:
    valid = F.lit(True)
    for part in PARTS:
        valid = valid & F.col(part)
    return manifest.withColumn("is_valid", valid)


def trials_with_valid(manifest: DataFrame, trial: str = "trial") -> DataFrame:
    return with_validity(manifest).groupBy(trial).agg(F.bool_or("is_valid").alias("has_valid"))


def latest_checkpoint(manifest: DataFrame, trial: str = "trial", valid_only: bool = False) -> DataFrame:
    """The newest of each trial that has a valid one; with ``valid_only`` the newest valid one."""
    rows = with_validity(manifest)
    newest = F.struct("mtime", "name")
    picked = F.max(F.when(F.col("is_valid"), newest) if valid_only else newest)
    found = rows.groupBy(trial).agg(picked.alias("p"), F.bool_or("is_valid").alias("ok"))
    return found.filter("ok").select(trial, F.col("p.name").alias("latest"))


def best_checkpoint(manifest: DataFrame, trial: str = "trial") -> DataFrame:
    """The highest score of each trial that has a valid checkpoint; ties by name."""
    scored = F.when(F.col("score").isNotNull(), F.struct("score", "name"))
    found = with_validity(manifest).groupBy(trial).agg(F.max(scored).alias("p"), F.bool_or("is_valid").alias("ok"))
    return found.filter("ok").select(trial, F.col("p.name").alias("best"))


def with_retention(manifest: DataFrame, max_keep: int = 8, keep_best: bool = False, trial: str = "trial") -> DataFrame:
    """``keep``: which checkpoints survive when only ``max_keep`` per trial may stay.

    The oldest go first; with ``keep_best`` the lowest scores do, and rows without
    a score only when no scored row is left.  The rank is filtered at once, so
    tasks pass on no more than ``max_keep`` rows per trial; flags are joined back
    on the unique (trial, name).
    """
    if max_keep < 0:
        return manifest.withColumn("keep", F.lit(True))
    newest = [F.desc("mtime"), F.desc("name")]
    if keep_best:
        has_score = F.col("score").isNotNull()
        unscored_time = F.when(~has_score, F.col("mtime"))
        order = [has_score.asc(), F.desc(unscored_time), F.desc("score"), F.desc("name")]
    else:
        order = newest
    rank = F.row_number().over(Window.partitionBy(trial).orderBy(*order))
    kept = manifest.withColumn("__rank", rank).filter(F.col("__rank") <= max_keep)
    flags = kept.select(trial, "name", F.lit(True).alias("__kept"))
    flagged = manifest.join(flags, [trial, "name"], "left")
    return flagged.select(*manifest.columns, F.coalesce("__kept", F.lit(False)).alias("keep"))


def parse_checkpoint_path(df: DataFrame, path: str) -> DataFrame:
    """``checkpoint`` and ``saved_at`` out of a path; null where no such folder is named."""
    name = F.regexp_extract(path, CHECKPOINT_NAME, 0)
    named = df.withColumn("checkpoint", F.when(name != "", name))
    stamp = F.substring("checkpoint", len(CHECKPOINT_PREFIX) + 1, 19)
    return named.withColumn("saved_at", F.to_timestamp_ntz(stamp, F.lit(CHECKPOINT_TIME)))
