"""Sources and sinks: delimited text, Parquet views, nested JSON, annotation files, shard indices and materialised results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = "\t", names: Sequence[str] | None = None, columns: Sequence[str] | None = None, order: Sequence[str] | None = None, distinct: bool = False, header: bool = True) -> DataFrame:
    """A delimited file: rename, then project, then sort, then drop repeats. A missing path raises."""
    reader = spark.read.option("sep", sep).option("header", header)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    if names:
        df = df.toDF(*names)
    if columns:
        df = df.select(*columns)
    if order:
        df = df.orderBy(*order)
    return df.dropDuplicates() if distinct else df


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def write_text(df: DataFrame, path: str, line: Column) -> None:
    df.select(line.cast("string").alias("value")).write.mode("overwrite").text(path)


def view(spark: SparkSession, name: str, path: str) -> bool:
    """A view over all Parquet files below a folder; False if there are none."""
    try:
        df = spark.read.option("recursiveFileLookup", True).parquet(path)
    except Exception as e:  # noqa: BLE001  Spark's errors for missing paths and unreadable folders have no common class
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    df.createOrReplaceTempView(name)
    return True


def views(spark: SparkSession, root: str, names: Sequence[str]) -> list[str]:
    """Names of the views that could be made over root/name."""
    return [n for n in names if view(spark, n, f"{root}/{n}")]


def schema_summary(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "column string, type string, nullable boolean")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct count, non-null count, least and greatest of each column, in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("n_distinct"), F.count(c).alias("n"), F.min(F.col(c).cast("string")).alias("min"), F.max(F.col(c).cast("string")).alias("max")) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """Extremes, mean and share of negatives; signed if that share is between 0.2 and 0.8."""
    out = df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.avg((F.col(column) < 0).cast("double")).alias("frac_neg"), F.count_distinct(column).alias("n_distinct"))
    return out.withColumn("signed", (F.col("frac_neg") > 0.2) & (F.col("frac_neg") < 0.8))


def vocabulary_overlap(df: DataFrame, column: str, vocabularies: Mapping[str, DataFrame]) -> dict[str, int]:
    """How many distinct values of a column each one-column vocabulary has."""
    values = df.select(F.col(column).alias("v")).distinct()
    return {n: values.join(v.toDF("v").distinct(), "v", "left_semi").count() for n, v in vocabularies.items()}


def resolve_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename to each wanted name the first of its candidates that the table has; raises if none."""
    out, have = df, {c.lower(): c for c in df.columns}
    for want, names in candidates.items():
        hit = next((have[n.lower()] for n in names if n.lower() in have), None)
        if hit is None:
            raise ValueError(f"no column for {want}")
        out = out.withColumnRenamed(hit, want)
    return out


def shard_index(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """Least and greatest of a column in each Parquet file, by one pruned scan of that column."""
    return spark.read.parquet(*paths).groupBy(F.input_file_name().alias("shard")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n_rows"))


def index_coverage(index: DataFrame) -> DataFrame:
    """Blocks of shards that begin at the same value."""
    return index.groupBy("lo").agg(F.min("shard").alias("first"), F.max("shard").alias("last"), F.count("*").alias("n_shards"))


def scan_with_resume(source: DataFrame, shard: str, out: str, done: DataFrame | None = None) -> None:
    """Write the shards that are not done yet, partitioned by shard; each keeps its own folder, so a rerun goes on."""
    rows = source if done is None else source.join(done.select(shard).distinct(), shard, "left_anti")
    rows.write.mode("append").partitionBy(shard).parquet(out)


def with_retries(call: Callable, attempts: int = 5, first: float = 0.5, most: float = 30.0, transient: Callable[[Exception], bool] = lambda e: any(s in str(e) for s in ("429", "502", "503", "504", "timed out"))):
    """Result of a call to a service; transient errors are tried again with doubling pauses."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i == attempts - 1 or not transient(e):
                raise
            time.sleep(min(most, first * 2**i))


def cache_key(spark: SparkSession, **params) -> str:
    """Twelve hex digits that change with any parameter."""
    from hashlib import sha1

    return sha1(json.dumps(params, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()[:12]


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The Parquet table at ``path``, built and written first if it is missing or ``force``."""
    if force or not view(spark, "__probe", path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def without_ids(df: DataFrame) -> DataFrame:
    """Column names without a trailing number in parentheses, if all but the first have one."""
    import re

    rest = df.columns[1:]
    return df.toDF(df.columns[0], *[re.sub(r"\s*\(\d+\)$", "", c) for c in rest]) if rest and all("(" in c for c in rest) else df


def long_nonzero(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """A wide matrix as long rows, zeros and nulls left out."""
    return df.unpivot([key], [c for c in df.columns if c != key], name, value).where(F.col(value) != 0)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Pages of a service saved as JSON lines."""
    reader = spark.read.option("multiLine", False)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names; arrays stay."""

    def leaves(fields, path: tuple[str, ...]):
        for f in fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, here)
            else:
                yield here

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema.fields, ())])


def read_gff(spark: SparkSession, path: str, attributes: Sequence[str] = (), gtf: bool = False) -> DataFrame:
    """Annotation features; attributes are key=value; pairs, or key "value"; in GTF."""
    kinds = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attribute string"
    df = spark.read.schema(kinds).option("sep", "\t").option("comment", "#").csv(path)
    return df.select("*", *[gff_attribute("attribute", a, gtf).alias(a) for a in attributes])


def gff_attribute(column: str, name: str, gtf: bool = False) -> Column:
    rx = rf'(?:^|;\s*){name} "([^"]*)"' if gtf else rf"(?:^|;\s*){name}=([^;]*)"
    return F.nullif(F.regexp_extract(column, rx, 1), F.lit(""))


def expression_files(spark: SparkSession, glob: str, count: str = "unstranded") -> DataFrame:
    """All per-sample count files of a glob in one scan; the file's name is the sample; gene ids lose their versions, summary rows go."""
    df = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(glob)
    df = df.withColumn("sample_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)*$", 1))
    rows = df.where(F.col("gene_id").startswith("ENSG"))
    return rows.select("sample_id", F.regexp_replace("gene_id", r"\..*$", "").alias("geneid"), F.col("gene_name").alias("symbol"), F.col("gene_type").alias("biotype"), F.col(count).cast("long").alias("count"))


def attach(df: DataFrame, meta: DataFrame, on: str) -> DataFrame:
    """Left join of metadata on a key."""
    return df.join(meta, on, "left")


def export_for_matrix_market(df: DataFrame, row: str, column: str, value: str, path: str) -> None:
    """Sparse triplets with 1-based indices, and both label lists, as text folders."""
    from larkspan.operators.lineage import numbered

    labels = {c: numbered(df.select(c).where(F.col(c).isNotNull()).distinct(), [c], f"{c}_no") for c in (row, column)}
    body = df.where(F.col(value) != 0).join(labels[row], row).join(labels[column], column)
    body.select(F.concat_ws(" ", f"{row}_no", f"{column}_no", value).alias("value")).write.mode("overwrite").text(f"{path}/entries")
    for c, t in labels.items():  # files are in order and each is sorted
        t.orderBy(f"{c}_no").select(F.col(c).cast("string").alias("value")).write.mode("overwrite").text(f"{path}/{c}")


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small table as Markdown; numbers are rounded. One of more than ``most`` rows is refused, not cut down."""
    rows: pd.DataFrame = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table to a sink, or raise most")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows.itertuples(index=False))])


def display_safe(df: DataFrame) -> DataFrame:
    """Arrays as joined text, for viewers that show flat tables."""
    return df.select(*[F.array_join(F.col(f.name).cast("array<string>"), ", ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema])


def null_row(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([tuple(None for _ in schema)], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
