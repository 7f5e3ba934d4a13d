"""JSON-lines sources and sinks with the strictness the caller asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_strict(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; the job fails at the first line that is no object of the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_tolerant(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): lines that cannot be read (a torn last line, say) go to
    ``rejects`` with their file."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.text(paths).select(F.col("value"), F.input_file_name().alias("file")).where(F.trim("value") != "")
    parsed = raw.select("value", "file", F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    return parsed.where(good).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), parsed.where(~good).select("file", F.col("value").alias("line"))


def write_canonical(df: DataFrame, path: str, mode: str = "append") -> None:
    """One canonical JSON object a line: fields by name, nulls kept."""
    fields = F.struct(*[F.col(c) for c in sorted(df.columns)])
    df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def scan_papers(spark: SparkSession, root: str, papers: Sequence[str] | None, schema: T.StructType) -> DataFrame:
    """``root/<paper>/chunks.jsonl`` of the given papers (all where None), with the paper's name.
    An empty scan is an error."""
    paths = [f"{root}/{p}/chunks.jsonl" for p in papers] if papers is not None else f"{root}/*/chunks.jsonl"
    df = read_strict(spark, paths, schema).withColumn("paper", F.regexp_extract(F.input_file_name(), r"([^/]+)/chunks\.jsonl$", 1))
    if df.isEmpty():
        raise ValueError(f"no chunks under {root}")
    return df
