"""Tool-call linking: calls and results joined by identifier, in topological order; native.

``link_calls`` joins calls and results by (conversation, identifier), validates each
call's arguments against the schema of its tool, orders the calls of a conversation so
that each comes after those it depends on, and serialises call and result as canonical
JSON: keys sorted at every depth, no white space.

The result has one row for each identifier of a conversation.  Its calls and results
are first combined to the earliest one and their number, before the join, so that an
identifier that very many rows share does not meet in one task.

``level`` is the length of the longest chain of dependencies below a call; ``seq`` its
place in its conversation by level and position.  Levels are settled in rounds on the
open dependencies alone.  In each round a dependency on a call that itself waits for one
call only passes on to that one, so a chain takes rounds by the logarithm of its length;
calls that wait for several take a round for each of their levels.  Calls on a cycle, and
those that need them, never settle and have none.

Defined cases: ``status`` is ``linked``, ``no_result``, ``no_call`` (a result without a
call) or ``no_id`` (null identifier or conversation: one row for each conversation,
never linked).  Null or unparsable arguments, or other JSON than an object, give the
error ``not_object``; a null argument counts as missing.  A dependency that names no
call of the conversation gives the error ``unknown_dependency`` and is left out.
Repeated rows are counted in ``n_calls`` and ``n_results``; of ties in position the
least text is taken.  Empty tables are valid on either side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import number_rows
from lexloom.session import write_and_read

# Tool -> argument -> (type, required).
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

# Base of a call that never settles.
NEVER = 1 << 40

# What the type of a JSON value is called.
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def argument_errors(name: Column, parsed: Column, keys: Column, schemas: Schemas) -> Column:
    """Sorted array of ``missing:x``, ``type:x``, ``unknown:x``, ``unknown_tool``, ``not_object``."""
    none = F.array().cast("array<string>")
    checks: Column | None = None
    for tool, fields in schemas.items():
        found = [none]
        for field, (kind, required) in fields.items():
            path = '$["' + field.replace("\\", "\\\\").replace('"', '\\"') + '"]'
            value = F.try_variant_get(parsed, path, "variant")
            actual = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
            absent = value.isNull() | (actual == "VOID")
            wrong = F.when(absent, F.lit(f"missing:{field}") if required else F.lit(None)).when(
                ~actual.isin(*KINDS[kind]), F.lit(f"type:{field}")
            )
            found.append(F.array(wrong))
        extra = F.transform(
            F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>")),
            lambda k: F.concat(F.lit("unknown:"), k),
        )
        result = F.array_sort(F.array_compact(F.concat(*found, extra)))
        checks = F.when(name == tool, result) if checks is None else checks.when(name == tool, result)
    unknown = F.array(F.lit("unknown_tool"))
    known = unknown if checks is None else checks.otherwise(unknown)
    return F.when(keys.isNull(), F.array(F.lit("not_object"))).otherwise(known)


def levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``conv``, ``id``, ``level``) of all calls, and (``conv``, ``id``) of those with unknown dependencies.

    ``calls``: ``conv``, ``id``, ``depends_on``, one row for each identifier.
    """
    needs = calls.select("conv", "id", F.explode_outer("depends_on").alias("need")).filter("need IS NOT NULL").distinct()
    known = calls.select("conv", F.col("id").alias("need"), F.lit(True).alias("known"))
    needs = write_and_read(needs.join(known, ["conv", "need"], "left"), "needs")
    unknown = needs.filter("known IS NULL").select("conv", "id").distinct()
    needs = needs.filter("known").select("conv", "id", "need")
    most = calls.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    none = calls.select("conv", "id").join(needs, ["conv", "id"], "left_anti")
    # level(id) = max(base, weight + level(need)) over the rows of an id; need is null where nothing is open.
    rows = needs.selectExpr("conv", "id", "0L AS base", "need", "1L AS weight").union(
        none.selectExpr("conv", "id", "0L AS base", "CAST(NULL AS string) AS need", "CAST(NULL AS bigint) AS weight")
    ).withColumn("told", F.lit(False))
    settled = []
    while True:
        rows = write_and_read(rows, "needs")
        nodes = rows.groupBy("conv", "id").agg(
            F.max("base").alias("base"), F.count("need").alias("n_open"), F.max("need").alias("next"), F.max("weight").alias("step"), F.max("told").alias("told")
        )
        nodes = write_and_read(nodes.withColumn("n_open", F.when(F.col("base") >= NEVER, 0).otherwise(F.col("n_open"))), "level")
        settled.append(nodes.filter((F.col("n_open") == 0) & (F.col("base") < NEVER) & ~F.col("told")).select("conv", "id", F.col("base").cast("int").alias("level")))
        waiting = rows.filter("need IS NOT NULL").join(nodes.filter("n_open > 0").select("conv", "id"), ["conv", "id"], "left_semi")
        targets = nodes.select("conv", F.col("id").alias("need"), F.col("base").alias("below"), "n_open", "next", "step")
        met = waiting.join(targets, ["conv", "need"])
        weight = F.col("weight") + F.when(F.col("n_open") == 1, F.col("step")).otherwise(0)
        cyclic = (F.col("n_open") > 0) & (weight > most)
        need = F.when((F.col("n_open") == 0) | cyclic, F.lit(None)).when(F.col("n_open") == 1, F.col("next")).otherwise(F.col("need"))
        base = F.when(cyclic, F.lit(NEVER)).otherwise(F.greatest("base", F.col("weight") + F.col("below")))
        moved = met.select("conv", "id", base.alias("base"), need.alias("need"), F.when(need.isNotNull(), weight).alias("weight"), "n_open")
        moved = write_and_read(moved, "waiting")
        # Where all that is needed waits for two or more that wait, each call leads to a cycle.
        if moved.filter("n_open < 2").isEmpty():
            break
        rows = moved.groupBy("conv", "id", "need").agg(F.max("base").alias("base"), F.max("weight").alias("weight"))
        rows = rows.select("conv", "id", "base", "need", "weight", F.lit(False).alias("told"))
        # Settled calls that others were passed on to.
        asked = moved.filter("need IS NOT NULL").select("conv", F.col("need").alias("id")).distinct()
        kept = nodes.filter("n_open = 0").join(asked, ["conv", "id"], "left_semi")
        rows = rows.union(kept.selectExpr("conv", "id", "base", "CAST(NULL AS string)", "CAST(NULL AS bigint)", "true"))
    every = settled[0]
    for part in settled[1:]:
        every = every.union(part)
    return every, unknown


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each (``conv``, ``id``) of ``calls`` (``conv``, ``id``, ``position``, ``name``,
    ``arguments``, ``depends_on``) and ``results`` (``conv``, ``id``, ``position``, ``content``)."""
    first_call = calls.groupBy("conv", "id").agg(
        F.min(F.struct("position", "name", "arguments", "depends_on")).alias("call"), F.count(F.lit(1)).alias("n_calls")
    )
    first_result = results.groupBy("conv", "id").agg(
        F.min(F.struct("position", "content")).alias("result"), F.count(F.lit(1)).alias("n_results")
    )
    # Null identifiers equal nothing, so those rows stay apart on either side.
    joined = first_call.join(first_result, ["conv", "id"], "full_outer")
    linked = write_and_read(joined, "linked")
    named = linked.filter("call IS NOT NULL AND conv IS NOT NULL AND id IS NOT NULL")
    order, unknown = levels(named.select("conv", "id", "call.depends_on"))
    rows = linked.join(order, ["conv", "id"], "left").join(
        unknown.withColumn("__unknown", F.lit(True)), ["conv", "id"], "left"
    )
    parsed = rows.withColumn("__parsed", F.try_parse_json("call.arguments"))
    keys = F.json_object_keys(F.to_json("__parsed"))
    errors = argument_errors(F.col("call.name"), F.col("__parsed"), keys, schemas)
    errors = F.concat(errors, F.when(F.col("__unknown"), F.array(F.lit("unknown_dependency"))).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.col("conv").isNull() | F.col("id").isNull(), "no_id")
        .when(F.col("call").isNull(), "no_call")
        .when(F.col("result").isNull(), "no_result")
        .otherwise("linked")
    )
    canonical = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(F.to_json("__parsed"), F.lit("null")),
        F.lit(',"id":'),
        json_text(F.col("id")),
        F.lit(',"name":'),
        json_text(F.col("call.name")),
        F.lit(',"result":'),
        json_text(F.col("result.content")),
        F.lit("}"),
    )
    checked = parsed.select(
        "conv",
        "id",
        status.alias("status"),
        "level",
        F.coalesce("call.position", "result.position").alias("position"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("call").isNotNull(), errors).otherwise(F.array().cast("array<string>")).alias("errors"),
        canonical.alias("json"),
    )
    ordered = checked.withColumn("__open", F.isnull("level"))
    numbered = number_rows(ordered, ["conv", "__open", "level", "position", "id"], "__no", "ordered")
    starts = numbered.groupBy("conv").agg(F.min("__no").alias("__start"))
    starts = starts.withColumnRenamed("conv", "__conv")
    return numbered.join(starts, F.col("conv").eqNullSafe(F.col("__conv"))).select(
        *checked.columns, (F.col("__no") - F.col("__start")).alias("seq")
    )


def json_text(value: Column) -> Column:
    """A string as a JSON string; null as null."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))
