"""Reading and writing tables, headers, column profiles and role files."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.roles import FLOATS, INTEGERS, TIMES, CheckError

# Characters a header must not contain.
BAD_HEADER = list("\"'\\~`!@#$%^&*+={}?")


def read_table(spark: SparkSession, path: str, usecols: Sequence[str] | None = None, nrows: int | None = None,
               sep: str = ",", encoding: str = "UTF-8", header: bool = True, names: Sequence[str] | None = None,
               schema: T.StructType | str | None = None, skiprows: int = 0, fmt: str | None = None) -> DataFrame:
    """A table from csv, parquet, json or orc; the projection reaches the scan.

    Give a ``schema`` for large csv files: without one the file is read twice to infer types.
    """
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith((".csv", ".txt", ".tsv")) else "parquet")
    if fmt == "csv":
        reader = spark.read.option("sep", sep).option("encoding", encoding).option("header", header)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        if skiprows:
            df = _csv_lines(reader, _without_first_lines(spark, path, encoding, skiprows))
        else:
            df = reader.csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    if names:
        df = df.toDF(*names)
    if usecols:
        df = df.select(*usecols)
    return df.limit(nrows) if nrows is not None else df


def _without_first_lines(spark: SparkSession, path: str, encoding: str, skiprows: int) -> DataFrame:
    """The lines of every file but its first ``skiprows`` ones (which must lie in the file's first split)."""
    lines = spark.read.option("encoding", encoding).text(path).select(
        "value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # the rows of a split follow each other, so ids count from the id of its first row; one row for each file
    first = lines.filter("block = 0").groupBy(F.col("file").alias("first_file")).agg(F.min("at").alias("first_at"))
    head = (F.col("block") == 0) & (F.col("at") < F.col("first_at") + skiprows)
    joined = lines.join(first, F.col("file") == F.col("first_file"), "left")
    return joined.filter(~F.coalesce(head, F.lit(False))).select("value")


def _csv_lines(reader, lines: DataFrame) -> DataFrame:
    """Lines parsed by the csv reader inside the JVM."""
    spark = lines.sparkSession
    texts = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(texts), spark)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def check_head(names: Sequence[str] | str) -> None:
    """Refuse headers with symbols; names or the raw first line (commas ignored)."""
    text = names.replace(",", "") if isinstance(names, str) else "".join(names).replace(",", "")
    bad = [c for c in BAD_HEADER if c in text]
    if bad:
        raise CheckError(3001, bad)


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return row.value if row else ""


def has_header(spark: SparkSession, path: str, share: float = 0.5, sep: str = ",") -> bool:
    """Whether the first line names columns: how many columns have a first cell seen nowhere else.

    One read and one aggregate: a first cell that no other row repeats adds one distinct value.
    """
    raw = spark.read.option("sep", sep).option("header", False).csv(path)
    first = raw.first()
    if first is None:
        return False
    again = raw.agg(*[F.count(F.when(F.col(c).eqNullSafe(F.lit(first[c])), 1)).alias(c) for c in raw.columns]).first()
    return sum(1 for c in raw.columns if first[c] is not None and again[c] == 1) >= share * len(raw.columns)


def require_header(spark: SparkSession, path: str, share: float = 0.5, sep: str = ",") -> None:
    if not has_header(spark, path, share, sep):
        raise CheckError(1002)


def write_profile(profile: DataFrame, path: str, extra: dict | None = None) -> None:
    """One JSON line per column; ``extra`` (length, impurity tokens) goes to every line."""
    more = json.dumps(extra or {}, ensure_ascii=False)
    profile.withColumn("extra", F.lit(more)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


PROFILE_SCHEMA = ("column_name string, initial_dtype string, advise_dtype string, dtype_for_process string, data_quality int, "
                  "count bigint, mean double, std double, min string, max string, nunique bigint, extra string")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).json(path)


def profile_types(profile: DataFrame) -> dict[str, str]:
    """Column -> int / float / object / bool / datetime; a time layout means datetime."""
    return {r["column_name"]: "datetime" if r["dtype_for_process"].startswith("%") else r["dtype_for_process"]
            for r in profile.select("column_name", "dtype_for_process").collect()}


_SPARK_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType()}


def profile_schema(profile: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(c, _SPARK_TYPES.get(t, T.StringType())) for c, t in profile_types(profile).items()])


def profile_roles(profile: DataFrame) -> tuple[list[str], list[str]]:
    """Numerical columns, and every other column."""
    rows = profile.select("column_name", "advise_dtype").collect()
    return ([r[0] for r in rows if r[1] == "numerical"], [r[0] for r in rows if r[1] != "numerical"])


def column_roles(df: DataFrame, label: str) -> dict:
    kinds = {f.name: "numeric" if isinstance(f.dataType, (*INTEGERS, *FLOATS)) else "time" if isinstance(f.dataType, TIMES) else "enum"
             for f in df.schema}
    return {"label": label, "length": len(df.columns), "col_types": kinds}


def write_column_roles(df: DataFrame, label: str, path: str) -> None:
    text = json.dumps(column_roles(df, label), ensure_ascii=False)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
