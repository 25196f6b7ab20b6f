"""Reports and model text from metadata-sized frames."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_sample(df: DataFrame, path: str, order: list[str], n: int = 1000) -> None:
    df.orderBy(*order).limit(n).write.mode("overwrite").csv(path, header=True)


def discovery_report(relationships: DataFrame, profiles: DataFrame, pretty: bool = True) -> str:
    """JSON of relationships, columns by table, counts by confidence and recommendations from warnings; a row a column or relationship."""
    found = [json.loads(r) for r in relationships.toJSON().collect()]
    columns: dict[str, list] = {}
    for r in profiles.select("table", F.to_json(F.struct("column", "data_type", "null_percent", "unique_percent", "primary_key_candidate")).alias("j")).collect():
        columns.setdefault(r["table"], []).append(json.loads(r["j"]))
    levels = {k: sum(r["confidence_level"] == k for r in found) for k in ("HIGH", "MEDIUM", "LOW")}
    body = {"metadata": {"relationships": len(found), **levels}, "tables": columns, "relationships": found, "recommendations": sorted({w for r in found for w in r.get("warnings", [])})}
    return json.dumps(body, indent=2 if pretty else None, default=str)


def literal_table(df: DataFrame, n: int, order: list[str]) -> str:
    """The first n rows as text of an inline table; nulls as BLANK(), whole numbers without a point, quotes doubled."""
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "double": "DOUBLE", "float": "DOUBLE", "date": "DATETIME", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME", "boolean": "BOOLEAN"}

    def text(v) -> str:
        if v is None:
            return "BLANK()"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return str(int(v)) if float(v).is_integer() else str(v)
        return '"' + str(v).replace('"', '""') + '"'

    head = ", ".join(f'"{c}", {kinds.get(t, "STRING")}' for c, t in df.dtypes)
    rows = ", ".join("{" + ", ".join(map(text, r)) + "}" for r in df.orderBy(*order).limit(n).collect())
    return f"DATATABLE({head}, {{{rows}}})"


def entity_diagram(relationships: DataFrame) -> str:
    """A diagram's text, a line a relationship."""
    ends = {"OneToOne": "||--||", "OneToMany": "||--o{", "ManyToOne": "}o--||", "ManyToMany": "}o--o{"}
    rows = relationships.select("from_table", "to_table", "cardinality", "from_column").orderBy("from_table", "to_table").collect()
    return "\n".join(["erDiagram", *[f"    {r['from_table']} {ends[r['cardinality']]} {r['to_table']} : {r['from_column']}" for r in rows]])


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> list[str]:
    """A folder of files for each table; their paths in order."""
    paths = [f"{folder.rstrip('/')}/{name}" for name in tables]
    for (_, df), path in zip(tables.items(), paths):
        df.write.mode("overwrite").option("header", True).format(kind).save(path)
    return paths


def workbook_report(sheets: dict[str, DataFrame], names: dict[str, str], folder: str) -> list[str]:
    """Sheets as CSV folders, with raw names in text columns replaced by friendly ones, longest first, so that no name is cut by a shorter one."""

    def friendly(df: DataFrame) -> DataFrame:
        for raw, name in sorted(names.items(), key=lambda x: -len(x[0])):
            df = df.withColumns({c: F.replace(F.col(f"`{c}`"), F.lit(raw), F.lit(name)) for c, t in df.dtypes if t == "string"})
        return df

    return write_tables({k: friendly(df) for k, df in sheets.items()}, folder)


class ResultStore:
    """Results of jobs as files of one folder a job: saved, read, replaced, tested for and deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, job: str) -> str:
        return f"{self.folder}/{job}"

    def _at(self, job: str):
        return fs.FileSystem.from_uri(self._path(job))

    def save(self, job: str, df: DataFrame) -> str:
        df.write.mode("overwrite").parquet(self._path(job))
        return self._path(job)

    def get(self, job: str) -> DataFrame:
        return self.spark.read.parquet(self._path(job))

    def has(self, job: str) -> bool:
        store, path = self._at(job)
        return store.get_file_info(path).type == fs.FileType.Directory

    def delete(self, job: str) -> None:
        store, path = self._at(job)
        if self.has(job):
            store.delete_dir(path)

    def all(self) -> dict[str, DataFrame]:
        """Every job's result by name."""
        store, path = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {f.base_name: self.get(f.base_name) for f in found if f.type == fs.FileType.Directory}


def append_state(rows: DataFrame, folder: str) -> None:
    """Adds rows to a state table; states are read by their last rows, so nothing is changed in place."""
    rows.write.mode("append").parquet(folder)
