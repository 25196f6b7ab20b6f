"""Tables from files: loading, cleaning, catalogs."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import table_name
from ..operators.profile import generic_type

MOST_FILES = 5
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".xlsx": "excel", ".xls": "excel", ".xlsm": "excel"}


def file_format(path: str) -> str:
    """By the path's ending, whatever its case."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind is None:
        raise ValueError(f"{path}: only {', '.join(sorted(FORMATS))} are supported")
    return kind


def unique_names(names: Iterable[str]) -> list[str]:
    """Trimmed names; empty and unnamed ones get their position, repeated ones a number."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip()
        n = f"Unnamed_{i}" if not n or n.startswith("Unnamed") or n == f"_c{i}" else n
        seen[n] = seen.get(n, -1) + 1
        out.append(n if not seen[n] else f"{n}_{seen[n]}")
    return out


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A CSV file with a header; the second encoding is taken where the first leaves characters that it can't decode."""
    reader = lambda e: spark.read.csv(path, header=True, inferSchema=True, encoding=e)
    df = reader(encodings[0])
    texts = [c for c, t in df.dtypes if t == "string"]
    broken = bool(texts) and not df.where(F.concat_ws("", *[F.col(f"`{c}`") for c in texts]).contains("�")).isEmpty()
    df = reader(encodings[1]) if broken and len(encodings) > 1 else df
    return df.toDF(*unique_names(df.columns))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The sheet with most rows, the first of equals. The old binary format (.xls) needs an optional reader."""
    if not path.lower().endswith(".xls"):
        from .sheets import read_sheet

        return read_sheet(spark, path)
    import pandas as pd

    sheets = pd.read_excel(path, sheet_name=None)
    best = max(sheets.values(), key=len)
    best.columns = unique_names(map(str, best.columns))
    return spark.createDataFrame(best.astype(object).where(best.notna(), None))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    kind = file_format(path)
    return read_csv(spark, path) if kind == "csv" else read_excel(spark, path) if kind == "excel" else spark.read.format(kind).load(path)


def cleaned(df: DataFrame) -> DataFrame:
    """Without columns and rows that are all null; two columns must be left."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for c, n in zip(df.columns, counts) if n]
    if len(kept) < 2:
        raise ValueError("a table needs rows and at least two columns")
    names = unique_names(kept)
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)]).na.drop("all")


def load_tables(spark: SparkSession, paths: list[str], most: int = MOST_FILES) -> dict[str, DataFrame]:
    """Tables by path; one bad file fails the load."""
    if not paths or len(paths) > most:
        raise ValueError(f"between one and {most} files are needed")
    return {p: cleaned(read_table(spark, p)) for p in paths}


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns, names)."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, df.count(), len(df.columns), df.columns) for t, df in tables.items()], "table string, rows long, columns int, names array<string>")


def catalog(spark: SparkSession) -> DataFrame:
    """(raw, name) of the session's tables and views, names made readable."""
    return spark.createDataFrame([(t.name, table_name(t.name)) for t in spark.catalog.listTables()], "raw string, name string")


def columns_of(df: DataFrame, table: str) -> DataFrame:
    """(table, ordinal, column, type, generic_type), from the schema alone."""
    rows = [(table, i, f.name, f.dataType.simpleString(), generic_type(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "table string, ordinal int, column string, type string, generic_type string")


def best_table(tables: dict[str, DataFrame], fields: set[str]) -> str:
    """The table with most of the fields, the first of equals."""
    return max(tables, key=lambda t: len(fields & {*tables[t].columns}))


def without(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """df without the columns that it has of those named, and their number."""
    known = [c for c in columns if c in df.columns]
    return df.drop(*known), len(known)


def renamed(df: DataFrame, captions: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({c: n for c, n in captions.items() if c in df.columns})


# Endings of files that may be loaded, and their largest size.
ENDINGS, MOST_BYTES = (".csv", ".xlsx", ".xls", ".parquet", ".json"), 100 << 20


def checked_uploads(spark: SparkSession, paths: list[str], most: int = MOST_BYTES) -> DataFrame:
    """(path, bytes, problem) of files before they are loaded; problem is null where there is none. Spark reads no empty files, so what isn't read is empty."""
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)/+", "$1/")
    read = spark.read.format("binaryFile").load(paths).select(plain(F.col("path")).alias("_path"), F.col("length").alias("bytes"))
    rows = spark.createDataFrame([(p,) for p in paths], "path string").join(F.broadcast(read), plain(F.col("path")) == F.col("_path"), "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    known = F.lower("path").rlike("(" + "|".join(e.replace(".", "[.]") for e in ENDINGS) + ")$")
    return rows.withColumn("problem", F.when(~known, "unknown kind of file").when(F.col("bytes") > most, "file too large").when(F.col("bytes") == 0, "file is empty"))


def preview_rows(df: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, int]:
    """The first n rows with dates and times as text, and the number of all rows."""
    text = [F.col(f"`{c}`").cast("string").alias(c) if t.startswith(("date", "timestamp")) else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.orderBy(*order).limit(n).select(*text), df.count()
