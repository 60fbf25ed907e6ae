"""Rules and predictions as JSON lines, text and parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.ruleset import MEASURES, rule_text
from lodeweave.plans.shapes import ATOM


def write_rules(rules: DataFrame, path: str, kind: str = "ndjson", names: DataFrame | None = None) -> None:
    """``kind``: ndjson or json (one object a line), text (write only) or parquet."""
    if kind in ("parquet", "cache"):
        rules.write.mode("overwrite").parquet(path)
    elif kind in ("text", "txt"):
        rule_text(rules, names).select("text").write.mode("overwrite").text(path)
    elif kind in ("json", "ndjson"):
        have = [(m, c) for m, c in MEASURES.items() if c in rules.columns]
        rules.select(F.to_json(F.struct("canon", "head", "body", F.struct(*[F.col(c).alias(m) for m, c in have]).alias("measures"))).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {kind}")


def read_rules(spark: SparkSession, path: str, kind: str = "ndjson") -> DataFrame:
    """Rules written by ``write_rules``; measure names are read in either spelling."""
    if kind in ("parquet", "cache"):
        return spark.read.parquet(path)
    integers = ("Support", "HeadSupport", "HeadSize", "BodySize", "QpcaBodySize", "PcaBodySize")
    types = {m: "bigint" if m in integers else "int" if m == "Cluster" else "double" for m in MEASURES}
    spark_case = f"canon string, head {ATOM}, body array<{ATOM}>, measures map<string,double>"
    rows = spark.read.text(path).select(F.from_json("value", spark_case).alias("r")).where("r.head is not null")
    value = lambda m: F.coalesce(F.col("r.measures")[m], F.col("r.measures")[m[0].lower() + m[1:]]).cast(types[m])
    return rows.select(F.xxhash64("r.canon").alias("rule_id"), "r.canon", "r.head", "r.body", *[value(m).alias(c) for m, c in MEASURES.items()])


def write_predictions(predictions: DataFrame, path: str, kind: str = "ndjson") -> None:
    if kind in ("parquet", "cache"):
        predictions.write.mode("overwrite").parquet(path)
    else:
        predictions.select(F.to_json(F.struct(*predictions.columns)).alias("value")).write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str, schema: str, kind: str = "ndjson") -> DataFrame:
    return spark.read.parquet(path) if kind in ("parquet", "cache") else spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_index(facts: DataFrame, terms: DataFrame, path: str, test: DataFrame | None = None) -> None:
    """The dictionary, the facts and the test part side by side; each can be read alone."""
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    if test is not None:
        test.write.mode("overwrite").parquet(f"{path}/test")
    facts.write.mode("overwrite").parquet(f"{path}/facts")


def read_index(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{part}")
