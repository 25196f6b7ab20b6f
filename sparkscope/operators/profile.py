"""Profiles of columns and tables.

Two jobs profile all columns of a table: one aggregate in a single scan, and one table of values from which distinct counts,
duplicates and sequences follow. Values are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import normalized
from ..functions.typed import as_number, as_text, whole_number
from ..sources.shared import discard, written
from .quantiles import medians

TOP, SAMPLES = 20, 5
#: Rows that a task holds at once where their number is known.
TASK_ROWS = 1_000_000
MOSTLY_UNIQUE, FOREIGN_KEY, LEAST_CARDINALITY = 0.95, 0.70, 10
# Date formats by their pattern.
DATE_FORMATS = [(r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d"), (r"^\d{2}/\d{2}/\d{4}$", "%m/%d/%Y"), (r"^\d{2}-\d{2}-\d{4}$", "%d-%m-%Y"), (r"^\d{4}/\d{2}/\d{2}$", "%Y/%m/%d"), (r"^\d{2}\.\d{2}\.\d{4}$", "%d.%m.%Y")]
# Parts of names, and forms of values, that identifiers have.
ID_WORDS = ["id", "key", "code", "number", "_no", "_num"]
ID_PATTERNS = [r"^[A-Z]{2,4}\d+$", r"^\d{4,}$", r"^[A-Z]-\d+$"]


def generic_type(t: T.DataType) -> str:
    """NUMERIC, STRING, DATETIME, BOOLEAN or UNKNOWN."""
    if isinstance(t, T.NumericType):
        return "NUMERIC"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    return "BOOLEAN" if isinstance(t, T.BooleanType) else "UNKNOWN"


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def _pair(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("column"), value.alias("value"))


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value) with every value as text, nulls too."""
    cols = columns or scalar_columns(df)
    return df.select(F.inline(F.array(*[_pair(c, as_text(df, c)) for c in cols])))


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n): rows by value, nulls as a value."""
    return unpivoted(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def per_column(df: DataFrame, columns: list[str], **measures) -> DataFrame:
    """One aggregate over the table, turned to a row a column; each measure makes an aggregate from a column's name."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column"), *[m(c).alias(k) for k, m in measures.items()]).alias(f"c{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, row_count, null_count, null_percent, empty_count) in one scan; percents are 0 for an empty table."""
    empty = lambda c: F.count_if(F.col(f"`{c}`") == "") if isinstance(df.schema[c].dataType, T.StringType) else F.lit(0).cast("long")
    made = per_column(df, columns or scalar_columns(df), row_count=lambda c: F.count("*"), null_count=lambda c: F.count_if(F.col(f"`{c}`").isNull()), empty_count=empty)
    return made.withColumn("null_percent", F.round(F.coalesce(F.try_divide(F.col("null_count") * 100.0, "row_count"), F.lit(0.0)), 4)).select("column", "row_count", "null_count", "null_percent", "empty_count")


def uniqueness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, non_null, unique_count, unique_percent, duplicate_count, cardinality): percent of non-null rows, cardinality of all rows."""
    f = frequencies(df, columns).groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("unique_count"))
    return f.select(
        "column", "non_null", "unique_count", F.round(F.coalesce(F.try_divide(F.col("unique_count") * 100.0, "non_null"), F.lit(0.0)), 4).alias("unique_percent"),
        (F.col("non_null") - F.col("unique_count")).alias("duplicate_count"), F.round(F.coalesce(F.try_divide(F.col("unique_count") * 1.0, "rows"), F.lit(0.0)), 4).alias("cardinality"),
    )


def numeric_stats(df: DataFrame, columns: list[str], exact_median: bool = False) -> DataFrame:
    """(column, min, max, mean, median, std): the median by a sketch unless exact, std of the sample."""
    d = lambda c: F.col(f"`{c}`").cast("double")
    measures = {"min": lambda c: F.min(d(c)), "max": lambda c: F.max(d(c)), "mean": lambda c: F.avg(d(c)), "std": lambda c: F.stddev_samp(d(c))}
    if exact_median:
        values = df.select(F.inline(F.array(*[_pair(c, d(c)) for c in columns])))
        found = per_column(df, columns, **measures).join(medians(values, ["column"], F.col("value")), "column", "left")
    else:
        found = per_column(df, columns, **measures, median=lambda c: F.percentile_approx(d(c), 0.5, 10_000))
    return found.select("column", "min", "max", "mean", "median", "std")


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    n = lambda c: F.length(f"`{c}`")
    return per_column(df, columns, min_length=lambda c: F.min(n(c)).cast("long"), max_length=lambda c: F.max(n(c)).cast("long"), avg_length=lambda c: F.avg(n(c)))


def date_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min_date, max_date, days)."""
    d = lambda c: F.to_date(F.col(f"`{c}`").try_cast("timestamp"))
    made = per_column(df, columns, min_date=lambda c: F.min(d(c)), max_date=lambda c: F.max(d(c)))
    return made.withColumn("days", F.datediff("max_date", "min_date").cast("long"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP) -> DataFrame:
    """(column, rank, value, n): the k most frequent values, ties by value. Only k rows of each task reach the ranking."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return frequencies(df, columns).where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column", F.col("rank").cast("long").alias("rank"), "value", "n")


def sequential(df: DataFrame, columns: list[str], share: float = 0.95) -> DataFrame:
    """(column, steps, unit_steps, is_sequential): steps between the sorted values, duplicates included, and those of exactly one.

    For whole numbers a unit step ends at every distinct value whose predecessor is there, so no global sort is needed; numbers
    of any size are exact. Columns with other values, or whole numbers beyond 38 digits, aren't sequential.
    """
    of = {c: whole_number(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}
    if all(isinstance(df.schema[c].dataType, T.IntegralType) for c in columns):
        of = {c: F.col(f"`{c}`").cast("long") for c in columns}
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), of[c].alias("value"), F.col(f"`{c}`").isNotNull().alias("some")) for c in columns]))).where("some")
    f = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    after = f.select("column", F.try_add(F.col("value"), F.lit(1).cast(f.schema["value"].dataType)).cast(f.schema["value"].dataType).alias("value"), F.lit(1).alias("unit")).where("value is not null")
    stats = f.join(after, ["column", "value"], "left").groupBy("column").agg(F.sum("n").alias("rows"), F.count("unit").alias("unit_steps"), F.bool_and(F.col("value").isNotNull()).alias("whole"))
    steps = F.col("rows") - 1
    return stats.select("column", steps.alias("steps"), "unit_steps", (F.col("whole") & (steps > 0) & (F.col("unit_steps") > share * steps)).alias("is_sequential"))


def surely_sequential(rows: int, unique: int, low: int, high: int, share: float = 0.95) -> bool | None:
    """What the counts and the ends of a column of whole numbers tell of its unit steps; None if only the values can."""
    steps, missing = rows - 1, high - low + 1 - unique
    if steps <= 0 or unique - 1 - (missing > 0) <= share * steps:
        return False
    # Each missing number ends one run of numbers at most.
    return True if unique - 1 - missing > share * steps else None


def case_pattern(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, case_pattern): UPPER, LOWER, TITLE or MIXED, if every value has it."""
    v = lambda c: F.col(f"`{c}`")
    cased = lambda c: F.coalesce(F.bool_and(v(c).rlike("[A-Za-z]")), F.lit(False))
    # Title case: an upper-case letter wherever a letter follows something else.
    title = lambda c: ~v(c).rlike("(^|[^A-Za-z])[a-z]") & ~v(c).rlike("[A-Za-z][A-Z]")
    kind = lambda c: F.when(cased(c) & F.bool_and(v(c) == F.upper(v(c))), "UPPER").when(cased(c) & F.bool_and(v(c) == F.lower(v(c))), "LOWER").when(cased(c) & F.bool_and(title(c)), "TITLE").otherwise("MIXED")
    return per_column(df, columns, case_pattern=kind)


def common_prefix(df: DataFrame, columns: list[str], longest: int = 9, share: float = 0.9) -> DataFrame:
    """(column, prefix, has_prefix): the longest beginning, nine characters at most, that over 90 % of the values share at each length."""
    f = frequencies(df, columns).where("value is not null")
    cut = f.select("column", "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct(k.alias("k"), F.substring("value", 1, k).alias("p")))).alias("s")).where(F.length("s.p") == F.col("s.k"))
    best = cut.groupBy("column", "s.k", "s.p").agg(F.sum("n").alias("n"))
    total = f.groupBy("column").agg(F.sum("n").alias("total"))
    held = best.join(F.broadcast(total), "column").where(F.col("n") > share * F.col("total"))
    found = held.groupBy("column").agg(F.max_by("p", "k").alias("prefix"))
    return total.select("column").join(found, "column", "left").select("column", F.coalesce("prefix", F.lit("")).alias("prefix"), F.col("prefix").isNotNull().alias("has_prefix"))


def shape(value: Column) -> Column:
    """A value with its digits as 9, capitals as A and small letters as a."""
    return F.translate(value, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "9" * 10 + "A" * 26 + "a" * 26)


def shapes(df: DataFrame, columns: list[str], share: float = 0.8) -> DataFrame:
    """(column, shape, share): the most frequent shape of a column's values if over 80 % have it, else null."""
    f = frequencies(df, columns).where("value is not null").groupBy("column", shape(F.col("value")).alias("shape")).agg(F.sum("n").alias("n"))
    best = f.groupBy("column").agg(F.max_by("shape", F.struct("n", "shape")).alias("shape"), F.max("n").alias("most"), F.sum("n").alias("total"))
    part = F.col("most") / F.col("total")
    return best.select("column", F.when(part > share, F.col("shape")).alias("shape"), F.round(part, 6).alias("share"))


def date_format(df: DataFrame, columns: list[str], share: float = 0.9) -> DataFrame:
    """(column, date_format): the first format that over 90 % of the values have."""
    v = lambda c: F.col(f"`{c}`").cast("string")
    chain = lambda c: F.coalesce(*[F.when(F.avg(v(c).rlike(p).cast("int")) > share, f) for p, f in DATE_FORMATS], F.lit(None).cast("string"))
    return per_column(df, columns, date_format=chain)


def _inferred_type(df: DataFrame, c: str) -> Column:
    v, t = F.col(f"`{c}`"), generic_type(df.schema[c].dataType)
    if t == "NUMERIC":
        found = F.when(F.bool_and(v.cast("double") == F.floor(v.cast("double"))), "int").otherwise("float")
    elif t == "STRING":
        number = v.try_cast("double")
        dates = F.bool_and(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & v.try_cast("timestamp").isNotNull())
        numbers = F.count(number) > 0.9 * F.count(v)
        found = F.when(dates, "datetime").when(numbers & F.bool_and(number == F.floor(number)), "int").when(numbers, "float").otherwise("string")
    else:
        found = F.lit({"DATETIME": "datetime", "BOOLEAN": "boolean"}.get(t, "mixed"))
    return F.when(F.count(v) > 0, found).otherwise("unknown")


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, data_type): int, float, boolean, datetime, string or unknown by all values. Text whose values all are ISO-like dates is datetime; over 90 % numbers is int or float."""
    return per_column(df, columns, data_type=lambda c: _inferred_type(df, c))


def key_flags(profile: DataFrame, mostly_unique_pct: float = MOSTLY_UNIQUE, fk_pct: float = FOREIGN_KEY) -> DataFrame:
    """Adds is_unique, is_mostly_unique, primary_key_candidate and foreign_key_candidate to rows of unique_percent, null_percent and unique_count."""
    unique = F.col("unique_percent") >= 99.9
    return profile.select(
        "*", unique.alias("is_unique"), (F.col("unique_percent") >= mostly_unique_pct).alias("is_mostly_unique"), (unique & (F.col("null_percent") < 1) & (F.col("unique_count") >= LEAST_CARDINALITY)).alias("primary_key_candidate"),
        ((F.col("unique_percent") >= fk_pct) & (F.col("unique_count") >= LEAST_CARDINALITY)).alias("foreign_key_candidate"),
    )


# What a name says about its column, as a pattern.
HINTS = {"email": "e?mail", "phone": "phone|tel", "address": "addr", "code": "code", "name": "name"}
SUBJECTS = {"Customer": "customer|client", "Product": "product|item", "Order": "order", "Transaction": "transaction"}


def id_named(column: str) -> bool:
    return any(w in column.lower() for w in ID_WORDS)


def name_hints(columns: DataFrame, column: str = "column") -> DataFrame:
    """Rows of column names with words, subject, and a flag for each of HINTS: what the names suggest. The first subject that is a word of its own counts, else Unknown."""
    name = F.lower(F.regexp_replace(F.col(column), "[_-]", " "))
    subject = F.coalesce(*[F.when(name.rlike(rf"(^|\s)({p})(\s|$)"), s) for s, p in SUBJECTS.items()], F.lit("Unknown"))
    flags = {f"looks_like_{k}": name.rlike(p) for k, p in HINTS.items()}
    return columns.withColumns({"words": F.filter(F.split(name, r"\s+"), lambda w: w != ""), "subject": subject, "looks_like_id": F.lower(column).rlike("|".join(ID_WORDS)), **flags})


def id_like(df: DataFrame, columns: list[str], share: float = 0.8) -> DataFrame:
    """(column, looks_like_id): by its name, or over 80 % of its values have the form of an identifier, or whole numbers without a gap."""
    v = lambda c: as_text(df, c)
    some = lambda c: F.coalesce(reduce(lambda a, b: a | b, [F.avg(v(c).rlike(p).cast("int")) > share for p in ID_PATTERNS]), F.lit(False))
    made = per_column(df, columns, looks_like_id=lambda c: F.lit(True) if id_named(c) else some(c))
    whole = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType) and not id_named(c)]
    if not whole:
        return made
    return made.join(F.broadcast(sequential(df, whole).select("column", "is_sequential")), "column", "left").select("column", (F.col("looks_like_id") | F.coalesce("is_sequential", F.lit(False))).alias("looks_like_id"))


def _grouped_as(t: T.DataType) -> str:
    """The type by which equal values of a column are grouped: its own where unlike values have unlike texts, else text."""
    if isinstance(t, T.IntegralType):
        return "long"
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "double"
    return "date" if isinstance(t, T.DateType) else "timestamp_ntz" if isinstance(t, T.TimestampNTZType) else "string"


def distinct_values(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, column, value, n) of the distinct values of the columns of all tables, nulls too, as exact text; n rows have it.

    Values are grouped by type, pre-aggregated, with one scan a table and one shuffle for each type; numbers and times become
    text when they have been grouped. Tables without columns have no rows.
    """
    wanted = [(t, c) for t, df in tables.items() for c in (scalar_columns(df) if columns is None else columns.get(t, []))]
    kinds: dict[str, dict[str, list[Column]]] = {}
    for i, (t, c) in enumerate(wanted):
        kind = _grouped_as(tables[t].schema[c].dataType)
        v = as_text(tables[t], c) if kind == "string" else F.col(f"`{c}`").cast(kind)
        kinds.setdefault(kind, {}).setdefault(t, []).append(F.struct(F.lit(i).alias("i"), v.alias("value")))
    name = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in wanted]), F.col("i") + 1)
    parts = []
    for of in kinds.values():
        f = reduce(DataFrame.unionByName, [tables[t].select(F.inline(F.array(*rows))) for t, rows in of.items()]).groupBy("i", "value").agg(F.count("*").alias("n"))
        parts.append(f.select(name(0).alias("table"), name(1).alias("column"), as_text(f, "value").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def data_type_of(kind: str, some: int, whole: bool, numbers: int, dates: bool) -> str:
    """int, float, boolean, datetime, string, mixed or unknown, by a column's generic type and what its values are."""
    if not some:
        return "unknown"
    if kind == "NUMERIC":
        return "int" if whole else "float"
    if kind == "STRING":
        return "datetime" if dates else ("int" if whole else "float") if numbers > 0.9 * some else "string"
    return {"DATETIME": "datetime", "BOOLEAN": "boolean"}.get(kind, "mixed")


def profiles_from(tables: dict[str, DataFrame], values: DataFrame, statistics: bool = True) -> DataFrame:
    """Column profiles of tables by their distinct_values and one more scan of the numbers, for ends, means and medians. A row a column: metadata, made on the driver.

    Whether whole numbers stand in a row follows from their ends and counts for nearly all columns; the others are counted. Without
    statistics the second scan is left out, and ends, means, medians, deviations and is_sequential are null.
    """
    spark, v, n = values.sparkSession, F.col("value"), F.col("n")
    known, number = v.isNotNull(), as_number(v)
    counts = values.groupBy("table", "column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(known, n).otherwise(0)).alias("non_null"), F.count("value").alias("unique"), F.sum(F.when(v == "", n).otherwise(0)).alias("empty"),
        F.sum(F.when(number.isNotNull(), n).otherwise(0)).alias("numbers"), F.bool_and(~known | (number == F.floor(number))).alias("whole"), F.bool_and(~known | (v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}") & v.try_cast("timestamp").isNotNull())).alias("dates"),
    )
    found = {(r["table"], r["column"]): r for r in counts.collect()}
    moments, in_a_row = [], {}
    for t, df in tables.items():
        cols = [f.name for f in df.schema if statistics and isinstance(f.dataType, T.NumericType)]
        d = lambda c: F.col(f"`{c}`").cast("double")
        w = lambda c: whole_number(F.col(f"`{c}`"), df.schema[c].dataType)  # noqa: B023, E731
        if cols:
            of = per_column(
                df, cols, min=lambda c: F.min(d(c)), max=lambda c: F.max(d(c)), mean=lambda c: F.avg(d(c)), median=lambda c: F.percentile_approx(d(c), 0.5, 10_000), std=lambda c: F.stddev_samp(d(c)),
                low=lambda c: F.min(w(c)), high=lambda c: F.max(w(c)), whole=lambda c: F.bool_and(F.col(f"`{c}`").isNull() | w(c).isNotNull()),
            )
            moments.append(of.select(F.lit(t).alias("table"), "*"))
    stats = {(r["table"], r["column"]): r for r in reduce(DataFrame.unionByName, moments).collect()} if moments else {}
    for t, df in tables.items():
        for c in (c for s, c in stats if s == t):
            r, m = found.get((t, c)), stats[t, c]
            in_a_row[t, c] = bool(r and r["non_null"] and m["whole"]) and surely_sequential(r["non_null"], r["unique"], int(m["low"]), int(m["high"]))
        if unsure := [c for (s, c), x in in_a_row.items() if s == t and x is None]:
            in_a_row |= {(t, r["column"]): r["is_sequential"] for r in sequential(df, unsure).collect()}
    rows = []
    for t, df in tables.items():
        for i, c in enumerate(scalar_columns(df)):
            r, m, kind = found.get((t, c)), stats.get((t, c)), generic_type(df.schema[c].dataType)
            total, some, unique = (r["rows"], r["non_null"], r["unique"]) if r else (0, 0, 0)
            data_type = data_type_of(kind, some, bool(r and r["whole"]), r["numbers"] if r else 0, bool(r and r["dates"]))
            percent = lambda x, y: round(x * 100.0 / y, 4) if y else 0.0
            rows.append((
                t, i, normalized(c), c, total, total - some, percent(total - some, total), r["empty"] if r and kind == "STRING" else 0, some, unique, percent(unique, some), some - unique, round(unique / total, 4) if total else 0.0, data_type,
                *([m[k] for k in ("min", "max", "mean", "median", "std")] if m else [None] * 5), in_a_row.get((t, c)),
            ))
    schema = "table string, ordinal int, normalized_name string, column string, row_count long, null_count long, null_percent double, empty_count long, non_null long, unique_count long, unique_percent double, duplicate_count long, cardinality double, data_type string, min double, max double, mean double, median double, std double, is_sequential boolean"
    return key_flags(spark.createDataFrame(rows, schema))


def column_profiles(df: DataFrame, table: str) -> DataFrame:
    """A row for each column of a table: counts, percents, key flags, and statistics by type. Two jobs: one for all values, one for the numbers' moments."""
    tables = {table: df}
    return profiles_from(tables, distinct_values(tables))


def numeric_pattern(profiles: DataFrame) -> DataFrame:
    """Column profiles with numeric_pattern (SEQUENTIAL, UNIQUE_NUMERIC over 95 %, NON_UNIQUE_NUMERIC; null for other types) and key_kind (SURROGATE: whole numbers in a row, NATURAL: named like an identifier)."""
    numeric = F.col("data_type").isin("int", "float") & F.col("min").isNotNull()
    pattern = F.when(numeric, F.when(F.coalesce("is_sequential", F.lit(False)), "SEQUENTIAL").when(F.col("unique_percent") > 95, "UNIQUE_NUMERIC").otherwise("NON_UNIQUE_NUMERIC"))
    kind = F.when((F.col("data_type") == "int") & F.coalesce("is_sequential", F.lit(False)), "SURROGATE").when(F.lower("column").rlike("|".join(ID_WORDS)), "NATURAL")
    return profiles.withColumns({"numeric_pattern": pattern, "key_kind": kind})


def samples(df: DataFrame, columns: list[str] | None = None, k: int = SAMPLES) -> DataFrame:
    """(column, samples): the first k distinct non-null values in order, as text. Each task keeps k a column."""
    values = unpivoted(df, columns).where("value is not null").distinct()
    w = Window.partitionBy("column").orderBy("value")
    return values.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def preview(df: DataFrame, table: str, k: int = SAMPLES) -> DataFrame:
    """(table, column, data_type, null_count, unique_count, samples) of every column."""
    p = column_profiles(df, table).select("table", "column", "data_type", "null_count", "unique_count")
    return p.join(samples(df, k=k), "column", "left").select("table", "column", "data_type", "null_count", "unique_count", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def table_summary(profiles: DataFrame) -> DataFrame:
    """(table, row_count, column_count, numeric_columns, key_candidates, null_cells, columns): a row a table."""
    return profiles.groupBy("table").agg(
        F.max("row_count").alias("row_count"), F.count("*").alias("column_count"), F.count_if(F.col("data_type").isin("int", "float")).alias("numeric_columns"), F.count_if("primary_key_candidate").alias("key_candidates"),
        F.sum("null_count").alias("null_cells"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]), ",").alias("columns"),
    )


def json_rows(df: DataFrame) -> DataFrame:
    """(json) of each row: NaN and infinite numbers are null, dates and times ISO text, nulls written out."""
    safe = lambda c, t: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) if t in ("double", "float") else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if t.startswith("timestamp") else c
    return df.select(F.to_json(F.struct(*[safe(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes]), {"ignoreNullFields": "false"}).alias("json"))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df by the hash of some columns in as many partitions as its rows need, so that what a task holds does not grow with the table."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *by)


def composite_keys(df: DataFrame, columns: list[str] | None = None, most: int = 10) -> DataFrame:
    """(columns, size): pairs of columns without duplicate rows, or triples if there is no pair.

    Columns come in with between 10 and 95 % distinct values, the first ten of them. One aggregate of sketches drops the
    combinations that are far from unique. Of those left the keys' hashes are dealt out and counted; keys whose hashes repeat are
    counted themselves, so the result is exact. A task holds TASK_ROWS rows or so.
    """
    cols, spark = columns, df.sparkSession
    if cols is None:
        cardinality = {r["column"]: r["cardinality"] for r in uniqueness(df).select("column", "cardinality").collect()}
        cols = [c for c in scalar_columns(df) if 0.1 < cardinality[c] < 0.95][:most]
    key = lambda of: F.to_json(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in of]))
    found: list[tuple[str, ...]] = []
    for size in (2, 3):  # a hash passes over nulls, so it takes in where they are
        ways = [*combinations(cols, size)]
        if not ways:
            continue
        row = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.xxhash64(*[x for c in of for x in (F.col(f"`{c}`"), F.isnull(f"`{c}`"))]), 0.01).alias(f"w{i}") for i, of in enumerate(ways)]).first()
        near = [(i, of) for i, of in enumerate(ways) if row[f"w{i}"] >= 0.95 * row["n"]]
        if near:
            rows, each = row["n"] * len(near), lambda *more: df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("way"), F.xxhash64(key(of)).alias("h"), *[m(of).alias("key") for m in more]) for i, of in near])))  # noqa: B023, E731
            twice = written(dealt(each(), rows, "way", "h").groupBy("way", "h").agg(F.count("*").alias("n")).where("n > 1"), "twice")
            # Equal keys have equal hashes: without a hash that repeats no key does, and only rows of one that does are compared.
            repeated = set()
            if not twice.isEmpty():
                many = twice.agg(F.sum("n")).first()[0]
                same = dealt(each(key).join(twice.select("way", "h"), ["way", "h"], "left_semi"), many, "way", "h", "key").groupBy("way", "key").count().groupBy("way").agg(F.max("count").alias("most"))
                repeated = {r["way"] for r in same.where("most > 1").collect()}
            discard(twice)
            found = [of for i, of in near if i not in repeated]
        if found:
            break
    return spark.createDataFrame([(list(c), len(c)) for c in found], "columns array<string>, size int")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_count, distinct_rows, duplicate_count, duplicate_rate, status): exact; the rate in percent, under one is good."""
    cols = [F.col(f"`{c}`") for c in columns or df.columns]
    counts = df.groupBy(*cols).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.count("*").alias("distinct_rows"))
    rate = F.round(F.coalesce(F.try_divide((F.col("row_count") - F.col("distinct_rows")) * 100.0, "row_count"), F.lit(0.0)), 4)
    return counts.select("row_count", "distinct_rows", (F.col("row_count") - F.col("distinct_rows")).alias("duplicate_count"), rate.alias("duplicate_rate")).withColumn("status", F.when(F.col("duplicate_rate") < 1, "good").otherwise("warning"))


def slices(df: DataFrame, dims: list[str], n: int) -> DataFrame:
    """The first n distinct combinations of dims, in order."""
    return df.select(*dims).distinct().orderBy(*dims).limit(n)


def shared_names(tables: dict[str, list[str]]) -> dict[str, list[tuple[str, str]]]:
    """Columns by normal form of their names, those in two tables or more."""
    found: dict[str, list[tuple[str, str]]] = {}
    for t, cols in tables.items():
        for c in cols:
            found.setdefault(normalized(c), []).append((t, c))
    return {n: at for n, at in found.items() if len({t for t, _ in at}) > 1}
