"""Step log and checkpoint manifest, as checkable queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import runlog
from lexloom.plans.registry import query, table

LOG_INTERVAL, SAVE_INTERVAL = 5, 8

LOG = """steps as (
  select user_id as run, event_id as step, event_type as split, ts, 1 + event_id % 7 as batch_size,
    length(props) as n_tokens,
    case when event_id % 97 = 3 then 'nan'::double when event_id % 89 = 5 then 'inf'::double else value end as loss
  from events),
counted as (
  select *, row_number() over w as n_batches, sum(batch_size) over w as n_examples from steps
  window w as (partition by run order by step rows unbounded preceding))"""

MANIFEST = """manifest as (
  select user_id as trial, 'checkpoint_' || lpad(event_id::varchar, 12, '0') as name, ts as mtime,
    case when event_id % 5 = 0 then null else value end as score, event_id % 2 = 0 as has_model,
    event_id % 3 <> 0 as has_optimizer, event_id % 5 <> 1 as has_schedule, event_id % 7 <> 2 as has_state,
    event_id % 11 <> 4 as has_config from events),
valid as (
  select *, has_model and has_optimizer and has_schedule and has_state and has_config as is_valid from manifest)"""


def step_log(spark: SparkSession, folder: str) -> DataFrame:
    step = F.col("event_id")
    loss = (
        F.when(step % 97 == 3, float("nan")).when(step % 89 == 5, float("inf")).otherwise(F.col("value"))
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        step.alias("step"),
        F.col("event_type").alias("split"),
        "ts",
        (1 + step % 7).alias("batch_size"),
        F.length("props").cast("bigint").alias("n_tokens"),
        loss.alias("loss"),
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("trial"),
        F.concat(F.lit("checkpoint_"), F.lpad(n.cast("string"), 12, "0")).alias("name"),
        F.col("ts").alias("mtime"),
        F.when(n % 5 != 0, F.col("value")).alias("score"),
        (n % 2 == 0).alias("has_model"),
        (n % 3 != 0).alias("has_optimizer"),
        (n % 5 != 1).alias("has_schedule"),
        (n % 7 != 2).alias("has_state"),
        (n % 11 != 4).alias("has_config"),
    )


def counted(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.with_counters(step_log(spark, folder))


@query(
    "running_counters",
    f"with {LOG} select run, step, n_batches, n_examples::bigint as n_examples from counted",
)
def running_counters(spark: SparkSession, folder: str) -> DataFrame:
    return counted(spark, folder).select("run", "step", "n_batches", "n_examples")


@query(
    "interval_flags",
    f"""with {LOG} select run, step, n_batches % {LOG_INTERVAL} = 0 as should_log,
        n_batches % {SAVE_INTERVAL} = 0 and (n_batches - 1) % 20 >= {SAVE_INTERVAL} as should_checkpoint from counted""",
)
def interval_flags(spark: SparkSession, folder: str) -> DataFrame:
    log = counted(spark, folder).withColumn("step_in_epoch", (F.col("n_batches") - 1) % 20)
    flagged = runlog.with_interval_flags(log, LOG_INTERVAL, SAVE_INTERVAL, "step_in_epoch")
    return flagged.select("run", "step", "should_log", "should_checkpoint")


@query(
    "interval_mean_loss",
    f"""with {LOG} select run, (n_batches - 1) // {LOG_INTERVAL} as interval_id,
      round(avg(case when step % 83 <> 7 then loss end), 6) as mean_loss
    from counted group by 1, 2 having count(*) = {LOG_INTERVAL}""",
)
def interval_mean_loss(spark: SparkSession, folder: str) -> DataFrame:
    """The whole log, with losses that are missing, infinite or not a number."""
    log = counted(spark, folder).withColumn("loss", F.when(F.col("step") % 83 != 7, F.col("loss")))
    return runlog.interval_loss(log, LOG_INTERVAL).withColumn("mean_loss", F.round("mean_loss", 6))


@query(
    "evaluation_mean",
    "select round(avg(value), 6) as eval_loss, count(*) as n_steps from events",
)
def evaluation_mean(spark: SparkSession, folder: str) -> DataFrame:
    means = runlog.evaluation_mean(table(spark, folder, "events"), "value")
    return means.withColumn("eval_loss", F.round("eval_loss", 6))


@query(
    "throughput",
    f"""with {LOG}, t as (
      select split, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 as runtime, sum(batch_size) as samples,
        count(*) as steps, sum(n_tokens) as tokens from steps group by split)
    select split, round(runtime, 4) as runtime, round(samples / runtime, 5) as samples_per_second,
      round(steps / runtime, 5) as steps_per_second, round(tokens / runtime, 5) as tokens_per_second from t""",
)
def throughput(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.throughput(step_log(spark, folder), "split")


@query(
    "nan_watch",
    f"""with {LOG} select run, step, coalesce(bool_or(isnan(loss) or isinf(loss)) over (
          partition by run order by step rows between unbounded preceding and 1 preceding), false) as skipped
        from steps""",
)
def nan_watch(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.with_skipped_updates(step_log(spark, folder)).select("run", "step", "skipped")


@query("checkpoint_validity", f"with {MANIFEST} select trial, name, is_valid from valid")
def checkpoint_validity(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.with_validity(manifest(spark, folder)).select("trial", "name", "is_valid")


@query("trials_with_valid", f"with {MANIFEST} select trial, bool_or(is_valid) as has_valid from valid group by trial")
def trials_with_valid(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.trials_with_valid(manifest(spark, folder))


@query(
    "latest_checkpoint",
    f"""with {MANIFEST} select trial, name as latest from valid
        qualify bool_or(is_valid) over (partition by trial)
          and row_number() over (partition by trial order by mtime desc, name desc) = 1""",
)
def latest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.latest_checkpoint(manifest(spark, folder))


@query(
    "latest_valid_checkpoint",
    f"""with {MANIFEST} select trial, name as latest from valid where is_valid
        qualify row_number() over (partition by trial order by mtime desc, name desc) = 1""",
)
def latest_valid_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.latest_checkpoint(manifest(spark, folder), valid_only=True)


@query(
    "best_checkpoint",
    f"""with {MANIFEST} select trial, name as best from valid
        qualify bool_or(is_valid) over (partition by trial)
          and row_number() over (partition by trial order by score desc nulls last, name desc) = 1""",
)
def best_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.best_checkpoint(manifest(spark, folder))


@query(
    "retention_oldest",
    f"""with {MANIFEST} select trial, name,
        row_number() over (partition by trial order by mtime desc, name desc) <= 8 as keep from valid""",
)
def retention_oldest(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.with_retention(manifest(spark, folder)).select("trial", "name", "keep")


@query(
    "retention_best",
    f"""with {MANIFEST} select trial, name, row_number() over (
          partition by trial order by score is not null, case when score is null then mtime end desc nulls last,
            score desc, name desc) <= 20 as keep from valid""",
)
def retention_best(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.with_retention(manifest(spark, folder), 20, keep_best=True).select("trial", "name", "keep")


@query(
    "checkpoint_names",
    """select event_id, 'checkpoint_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') as checkpoint,
        date_trunc('second', ts) as saved_at from events""",
)
def checkpoint_names(spark: SparkSession, folder: str) -> DataFrame:
    stamp = F.date_format("ts", runlog.CHECKPOINT_TIME)
    path = F.concat(F.lit("/runs/"), F.col("user_id").cast("string"), F.lit("/checkpoint_"), stamp, F.lit("/model"))
    events = table(spark, folder, "events").select("event_id", path.alias("path"))
    return runlog.parse_checkpoint_path(events, "path").drop("path")
