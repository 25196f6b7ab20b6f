"""Column and table names: normal forms, variations, words, similarity. Names are metadata, so most of this runs on the driver."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations in column names and what they stand for.
ABBREVIATIONS = {
    "id": ["identifier", "id", "key"],
    "cust": ["customer", "cust", "client"],
    "prod": ["product", "prod", "item"],
    "qty": ["quantity", "qty", "count", "amount"],
    "amt": ["amount", "amt", "value", "total"],
    "dt": ["date", "dt", "day", "time"],
    "loc": ["location", "loc", "place", "site"],
    "cat": ["category", "cat", "type", "class"],
    "desc": ["description", "desc", "details"],
    "num": ["number", "num", "no", "#"],
    "addr": ["address", "addr"],
    "tel": ["telephone", "tel", "phone"],
    "email": ["email", "mail"],
    "acct": ["account", "acct"],
    "dept": ["department", "dept"],
    "mgr": ["manager", "mgr"],
    "emp": ["employee", "emp"],
    "org": ["organization", "org", "company"],
}


def normalized(name: str) -> str:
    """Lower case without underscores, spaces and hyphens."""
    return re.sub(r"[_ -]", "", name.lower())


def normalized_col(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[_ \\-]", "")


def variations(name: str) -> list[str]:
    """The normal form, then each with one abbreviated word written out, in the table's order."""
    parts = [w for w in re.split(r"[_\s-]+", name.lower()) if w]
    swapped = [[full if w == short else w for w in parts] for short, fulls in ABBREVIATIONS.items() if short in parts for full in fulls]
    return list(dict.fromkeys([normalized(name), *map("".join, swapped)]))


def words(name: str) -> list[str]:
    """Words of a name by underscores, spaces and changes of case; lower case, two letters at least."""
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", name.replace("_", " "))
    return [w.lower() for w in spaced.split() if len(w) > 1]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_ratio(a: str | None, b: str | None) -> float | None:
    """Likeness of two texts whose white-space tokens are sorted first: twice the common subsequence over both lengths. Case counts."""
    if a is None or b is None:
        return None
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def matcher_ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a.lower(), b.lower()).ratio()


@F.pandas_udf(T.DoubleType())
def token_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def matcher_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([matcher_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def table_name(raw: str) -> str:
    """A readable table name: the last dotted part without a hash suffix, numeric parts and separators."""
    last = re.sub(r"_[0-9A-Fa-f]{8,}$", "", raw.replace('"', "").split(".")[-1])
    parts = [p for p in re.split(r"[!_]", last) if p and not p.isdigit()]
    if "!" in last and len(parts) > 1:
        parts = parts[1:]  # the part before the first mark names the source
    name = "_".join(parts) or last
    return name.title() if name.islower() else name


def field_name(raw: str) -> str:
    """A field without brackets, data source, derivation prefix and key suffix: [ds].[sum:Sales:qk] is Sales."""
    inner = raw.split("].[")[-1].strip("[]")
    parts = inner.split(":")
    return parts[1] if len(parts) == 3 else parts[0] if len(parts) == 2 and parts[1] in ("nk", "qk", "ok", "tk") else inner


def unqualified(name: str) -> str:
    """A field without the table in brackets after it: `Sales (Orders)` is `Sales`."""
    return re.sub(r"\s*\([^()]*\)\s*$", "", name).strip()


def split_field(name: str) -> tuple[str, str]:
    """(table, column) by the first dot; the table is empty without one."""
    table, dot, column = name.partition(".")
    return (table, column) if dot else ("", name)


def references(formula: Column) -> Column:
    """Distinct [names] of a formula, in order."""
    return F.array_distinct(F.regexp_extract_all(formula, F.lit(r"\[([^\]]+)\]"), F.lit(1)))


def with_captions(formula: Column, captions: dict[str, str]) -> Column:
    """A formula with the ids of calculations in brackets replaced by their captions."""
    for name, caption in captions.items():
        formula = F.replace(formula, F.lit(f"[{name}]"), F.lit(f"[{caption}]"))
    return formula


def unresolved(formula: Column) -> Column:
    """Whether a formula still names a calculation by its id, so that a person must look at it."""
    return formula.rlike(r"Calculation_\d+")


def number_format(text: Column) -> Column:
    """The format of numbers that comes nearest to a workbook's: millions, percents, whole numbers, two places, else as it is."""
    return (
        F.when(text.contains("M") & text.contains("0"), '#,##0,," M"').when(text.contains("%"), "0.00%").when(text.contains("#,##0"), "#,##0").when(text.contains("0.00"), "#,##0.00").otherwise(text)
    )


def slice_key(dims: list[str]) -> Column:
    """The values of a slice in the order of their dimensions' names, joined by bars; None for nulls."""
    return F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit("None")) for d in sorted(dims)])


def field_tables(formula: Column) -> Column:
    """(field, table) of every [Field (Table)] in a formula, in order, each once."""
    found = F.array_distinct(F.regexp_extract_all(formula, F.lit(r"(\[[^\[\]]+ \([^()]+\)\])"), F.lit(1)))
    pattern = r"^\[(.+) \(([^()]+)\)\]$"
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("field"), F.regexp_extract(x, pattern, 2).alias("table")))
