"""Stages kept on disk and reused, and the tokenizer's two tables."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from types import CodeType

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.tokenizer import MERGES_SCHEMA, VOCAB_SCHEMA, Tokenizer, tokenizer_from_tables
from lexloom.session import drop_stage

MANIFEST = "stage.json"
ALL_FIELDS = "spark.sql.debug.maxToStringFields"


def _code_digest(code: CodeType) -> str:
    """The instructions and constants of a function and of those defined inside it."""
    parts = [code.co_code.hex(), repr(code.co_names)]
    parts += [_code_digest(c) if isinstance(c, CodeType) else repr(c) for c in code.co_consts]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def _input_files(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, size and time of every file that ``df`` reads, by one listing of each folder."""
    spark = df.sparkSession
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    wanted = {path_of(f).toUri().getPath(): f for f in df.inputFiles()}
    found = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in wanted.values()}):
        target = path_of(folder)
        for status in target.getFileSystem(conf).listStatus(target):
            name = status.getPath().toUri().getPath()
            if name in wanted:
                found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def stage_fingerprint(df: DataFrame, build: Callable[[], DataFrame], version: str = "") -> str:
    """A digest of what a stage is made from: its input files with sizes and times, its plan,
    its schema, the code of ``build`` and ``version``."""
    spark = df.sparkSession
    known = spark.conf.get(ALL_FIELDS)
    spark.conf.set(ALL_FIELDS, str(2**31 - 1))  # else long plans are shortened
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(ALL_FIELDS, known)
    plan = re.sub(r"#\d+L?|@[0-9a-f]+|plan_id=\d+", "", plan)
    made_from = [_input_files(df), plan, df.schema.json(), _code_digest(build.__code__), version]
    return hashlib.sha256(json.dumps(made_from).encode()).hexdigest()


def _read_manifest(spark: SparkSession, path: str) -> dict:
    """What the manifest says; nothing where it is missing or not whole."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return {}
    try:
        return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(target.toString()).collect()))
    except (json.JSONDecodeError, Py4JJavaError):
        return {}


def _write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Written beside its place and then renamed, so it is there as a whole or not at all."""
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    draft, target = path_of(f"{path}/{MANIFEST}-{uuid.uuid4().hex}"), path_of(f"{path}/{MANIFEST}")
    files = target.getFileSystem(conf)
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(target):
        files.delete(target, False)
    if not files.rename(draft, target):
        raise OSError(f"the manifest of {path} could not be put in its place")


def cached_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], version: str = "") -> DataFrame:
    """The stage kept under ``path``, built and written first where it is missing or out of date.

    ``build`` makes the plan only and is called each time: it should run no job itself.  A
    manifest names the folder of the stage and the fingerprint of what it was made from,
    and is written last: a stage that was left half-written is never read.  The stage is built
    again when an input file, the plan, the code of ``build`` or ``version`` has changed;
    change ``version`` where a function that ``build`` calls changes what tasks do without
    changing the plan.  The superseded rows are deleted once the new manifest stands.
    """
    df = build()
    fingerprint = stage_fingerprint(df, build, version)
    known = _read_manifest(spark, path)
    if known.get("fingerprint") != fingerprint:
        folder = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{folder}")
        _write_manifest(spark, path, {"fingerprint": fingerprint, "rows": folder})
        if "rows" in known:
            drop_stage(spark, f"{path}/{known['rows']}")
        known = {"rows": folder}
    return spark.read.schema(df.schema).parquet(f"{path}/{known['rows']}")


def save_tokenizer(spark: SparkSession, tok: Tokenizer, path: str) -> None:
    """Write both tables; an existing target is an error."""
    tok.vocab_table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/vocab")
    tok.merges_table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/merges")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocab")


def load_merges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MERGES_SCHEMA).parquet(f"{path}/merges")


def load_tokenizer(spark: SparkSession, path: str, ensure_specials: bool = True) -> Tokenizer:
    """Read both tables; by default the special tokens every run needs are ensured."""
    tok = tokenizer_from_tables(load_vocab(spark, path), load_merges(spark, path))
    return tok.with_specials() if ensure_specials else tok
