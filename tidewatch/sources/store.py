"""Result documents and tables: declared reads, write-once sinks, provenance, rule files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidewatch.operators.alarms import LaggingRule, LeadingRule, Rule

RULE_SETTING = "spark.tidewatch.rule"

RUN_ROW = ("c DOUBLE, arm STRING, colour STRING, sev STRING, scen STRING, rep INT, seed BIGINT, t_lead INT, t_lag INT, dt_censored INT, "
           "dt_paired INT, lead_max_score DOUBLE, lead_fired BOOLEAN, lag_fired BOOLEAN, achieved_edge_frac DOUBLE, "
           "obs_cycles_with_data INT, n_cycles INT")


def read_rows(spark: SparkSession, path: str | Sequence[str], rows: str = "per_run_rows", schema: str = RUN_ROW) -> DataFrame:
    """The row list of result documents as a table, one document per file, each row with its file.

    The schema is declared: nothing is inferred and fields it does not name are not parsed into the plan.
    """
    row = StructType.fromDDL(schema)
    docs = spark.read.schema(StructType([StructField(rows, ArrayType(row))])).json(path, multiLine=True)
    return docs.select(F.explode(rows).alias("r"), F.col("_metadata.file_name").alias("source_file")).select("r.*", "source_file")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Content digest of every input file: rows ``(source_file, length, sha256)``."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "length", F.sha2("content", 256).alias("sha256"))


def row_digest(*cols: str) -> Column:
    """Aggregate: sum of 40-bit row hashes, a content digest for tables too large to hash as files."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return F.sum(F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("bigint"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a result table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write a result table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def plan_text(df: DataFrame) -> str:
    """The optimised plan without names and expression numbers: equal for queries that compute the same."""
    conf, setting = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(setting)
    conf.set(setting, str(1 << 30))
    try:
        return df._jdf.queryExecution().optimizedPlan().canonicalized().treeString()
    finally:
        conf.set(setting, before)


def input_versions(df: DataFrame) -> str:
    """Digest of the files a query reads: number of them, and a sum over hashes of their path, length and time of change."""
    files = df.inputFiles()
    if not files:
        raise ValueError("only a query over files can be kept: nothing tells when its input has changed")
    seen = df.sparkSession.read.format("binaryFile").load(files)
    text = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    row = seen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(text), 1, 14), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}|{row['s']}"


def materialised(df: DataFrame, root: str, version: str = "", partition_by: Sequence[str] = ()) -> DataFrame:
    """A table computed once and re-read after, in a folder of ``root`` named by what it is computed from.

    The name is a digest of the query's plan, its schema and the versions of its input files, so another query, another
    input or a changed one never meets an old result. A folder counts only once its write was complete. A plan shows a Python
    function by its name alone: whoever changes one changes ``version``. A query over rows that are not in files (or behind a
    checkpoint) is refused.
    """
    spark = df.sparkSession
    plan = plan_text(df)
    if "LogicalRDD" in plan or "ExistingRDD" in plan or "LocalRelation" in plan:
        raise ValueError("only a query over files can be kept: part of its rows come from memory")
    name = hashlib.sha256("\n".join([plan, df.schema.json(), input_versions(df), version]).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{name}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load_rule(spark: SparkSession, path: str | None = None) -> Rule:
    """A declared rule from its JSON file; the session setting names it when no path is given. Unknown fields are ignored."""
    path = path or spark.conf.get(RULE_SETTING, None)
    if path is None:
        return Rule()
    doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    known = lambda cls, d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in cls.__dataclass_fields__}
    return Rule(LeadingRule(**known(LeadingRule, doc.get("leading", {}))), LaggingRule(**known(LaggingRule, doc.get("lagging", {}))))


def write_rule(spark: SparkSession, rule: Rule, path: str) -> None:
    """Write a declared rule as the one JSON document of a new folder; :func:`load_rule` reads it."""
    spark.createDataFrame([(json.dumps(asdict(rule)),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def rule_table(spark: SparkSession, rule: Rule, evidence: DataFrame) -> DataFrame:
    """The chosen rule with its calibration evidence as one row, ready for :func:`write_once`."""
    fixed = [F.lit(json.dumps(v)).alias(k) for k, v in asdict(rule).items()]
    return evidence.select(*fixed, "*")
