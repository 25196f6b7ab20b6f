"""Whole jobs: discover relationships, describe a model, recommend."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.duplicates import duplicate_columns
from ..operators.graph import LOD, TABLE_CALCS
from ..operators.kept import KeptColumns
from ..operators.model import classified
from ..operators.profile import duplicate_rows
from ..operators.relationships import discover, profiles_of
from ..sources.sinks import discovery_report
from ..sources.tables import load_tables


@dataclass
class Discovery:
    """Tables with their profiles, relationships, classes and duplicates.

    dropped and renamed give the discovery after a person's change: relationships that are asked for again take facts, values
    and counts of columns from earlier runs, and scan only columns that a new name brings into play.
    """

    tables: dict[str, DataFrame]
    kept: KeptColumns | None = field(default=None, repr=False)

    def __post_init__(self):
        self.kept = self.kept or KeptColumns(self.tables)

    def _changed(self, kept: KeptColumns) -> Discovery:
        return Discovery(kept.tables, kept)

    def dropped(self, table: str, *columns: str) -> Discovery:
        return self._changed(self.kept.dropped(table, *columns))

    def renamed(self, table: str, to: dict[str, str]) -> Discovery:
        return self._changed(self.kept.renamed(table, to))

    def replaced(self, table: str, df: DataFrame) -> Discovery:
        return self._changed(self.kept.replaced(table, df))

    @property
    def profiles(self) -> DataFrame:
        return profiles_of(self.tables)

    def relationships(self, excluded: list[str] = (), fuzzy: bool = False, included: list[str] | None = None) -> DataFrame:
        """All relationships but the excluded ones, or only those included, by their ids; fuzzy counts values that are nearly alike."""
        found = discover(self.kept, fuzzy=fuzzy)
        if included is not None:
            found = found.where(F.col("relationship_id").isin(list(included)))
        return found.where(~F.col("relationship_id").isin(list(excluded))) if excluded else found

    def classes(self) -> DataFrame:
        return classified(self.tables)

    def duplicate_columns(self) -> dict[str, list[dict]]:
        return {t: duplicate_columns(df) for t, df in self.tables.items()}

    def quality(self) -> DataFrame:
        """Duplicate rows of each table."""
        made = [duplicate_rows(df).select(F.lit(t).alias("table"), "*") for t, df in self.tables.items()]
        out = made[0]
        for m in made[1:]:
            out = out.unionByName(m)
        return out

    def report(self) -> str:
        return discovery_report(self.relationships(), self.profiles)


def from_files(spark: SparkSession, paths: list[str]) -> Discovery:
    return Discovery(load_tables(spark, paths))


def recommendations(calcs: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: whether a date table, context filters or a row index are called for, by calculations (formula) and columns (column)."""
    c = calcs.agg(F.coalesce(F.bool_or(F.col("formula").rlike(LOD)), F.lit(False)).alias("has_lod"), F.coalesce(F.bool_or(F.col("formula").rlike(TABLE_CALCS)), F.lit(False)).alias("needs_row_index"))
    d = columns.agg(F.coalesce(F.bool_or(F.lower("column").rlike("date|_dt$|time")), F.lit(False)).alias("needs_date_table"))
    return c.join(F.broadcast(d))  # one row each
