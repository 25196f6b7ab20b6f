"""What a worksheet asks for: its shelves as dimensions and measures, its chart, its query, its addressing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Derivations that aggregate, and those that take a part of a date.
AGGREGATED, DATE_PARTS = r"^[A-Z]{3,}\(", r"^(YEAR|QUARTER|MONTH|DAY|WEEK|MDY|MY)\("
# Visuals by mark, and roles by shelf.
VISUALS = {"Bar": "barChart", "Line": "lineChart", "Area": "areaChart", "Circle": "scatterChart", "Shape": "scatterChart", "Square": "matrix", "Text": "tableEx", "Pie": "pieChart", "Map": "map", "Polygon": "filledMap", "Gantt Bar": "barChart"}
ROLES = {"rows": "Values", "cols": "Category", "color": "Legend", "size": "Size", "label": "Labels", "detail": "Details", "tooltip": "Tooltips"}


def inner(field: Column) -> Column:
    """The name in brackets of a shelf's field, or what it holds without them."""
    found = F.regexp_extract(field, r"\[([^\]]+)\]", 1)
    return F.when(found != "", found).otherwise(F.trim(F.translate(field, "[]", "")))


def resolved(shelves: DataFrame, fields: DataFrame) -> DataFrame:
    """(worksheet, place, name, kind, formula) of shelves (worksheet, shelf, place, field): each name of a worksheet once, at its first place.

    fields has name, caption, role, datatype, formula. A calculation is a dimension if its role is and the shelf doesn't aggregate
    it, else a calculated measure; other fields are measures if aggregated or by role, else dimensions. Unknown names are dimensions.
    """
    s = shelves.select("worksheet", "place", inner(F.col("field")).alias("name"), (F.trim("field").rlike(AGGREGATED) & ~F.trim("field").rlike(DATE_PARTS)).alias("aggregated"))
    f = fields.select("role", "formula", F.explode(F.array_distinct(F.array("name", F.coalesce("caption", "name")))).alias("known"), F.coalesce("caption", "name").alias("label"))
    m = s.join(F.broadcast(f), F.col("name") == F.col("known"), "left")
    dimension = F.coalesce(F.lower("role"), F.lit("dimension")) == "dimension"
    kind = F.when(F.col("formula").isNotNull(), F.when(dimension & ~F.col("aggregated"), "dimension").otherwise("calculated")).otherwise(F.when(F.col("aggregated") | ~dimension, "measure").otherwise("dimension"))
    first = m.groupBy("worksheet", "name").agg(F.min_by(F.struct("place", kind.alias("kind"), F.coalesce("label", "name").alias("label"), "formula"), "place").alias("f"))
    return first.select("worksheet", F.col("f.place").alias("place"), F.col("f.label").alias("name"), F.col("f.kind").alias("kind"), F.col("f.formula").alias("formula"))


def chart_types(shelves: DataFrame, fields: DataFrame) -> DataFrame:
    """(worksheet, chart) by what stands on rows and columns: measures on both scatter, a date against a measure is a line, a dimension against a measure bars, else text; measures beside empty shelves are a card."""
    dates = fields.where(F.col("datatype").isin("date", "datetime")).select(F.col("name").alias("_date")).distinct()
    text = F.trim("field")
    s = shelves.withColumn("_name", inner(F.col("field"))).join(F.broadcast(dates), F.col("_name") == F.col("_date"), "left")
    on, measure = lambda k: F.col("shelf") == k, text.rlike(AGGREGATED) & ~text.rlike(DATE_PARTS)
    n = s.groupBy("worksheet").agg(
        F.count_if(on("rows") & measure).alias("rm"), F.count_if(on("rows") & ~measure).alias("rd"), F.count_if(on("cols") & measure).alias("cm"), F.count_if(on("cols") & ~measure).alias("cd"),
        F.count_if(on("rows") & (text.rlike(DATE_PARTS) | F.col("_date").isNotNull())).alias("rt"), F.count_if(on("cols") & (text.rlike(DATE_PARTS) | F.col("_date").isNotNull())).alias("ct"), F.count_if(measure).alias("m"),
    )
    some = lambda c: F.col(c) > 0
    chart = F.when(some("rm") & some("cm"), "Scatter Plot").when((some("ct") & some("rm")) | (some("rt") & some("cm")), "Line Chart").when((some("rd") & some("cm")) | (some("cd") & some("rm")), "Bar Chart")
    chart = chart.when(some("rd") & some("cd"), "Text Table").when((F.col("rm") + F.col("rd") + F.col("cm") + F.col("cd") == 0) & some("m"), "Card").otherwise("Text Table")
    return n.select("worksheet", chart.alias("chart"))


def run(df: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """The rows that a worksheet shows: its measures by its dimensions."""
    return df.groupBy(*dimensions).agg(*[m.alias(n) for n, m in measures.items()])


def addressing(resolved_fields: DataFrame) -> DataFrame:
    """(worksheet, calculation, partition): for each calculated measure of a worksheet, the dimensions it restarts at, in order."""
    dims = resolved_fields.where("kind = 'dimension'").groupBy("worksheet").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("d"))
    calcs = resolved_fields.where("kind = 'calculated'").select("worksheet", F.col("name").alias("calculation"))
    return calcs.join(F.broadcast(dims), "worksheet", "left").select("worksheet", "calculation", F.coalesce(F.transform("d", lambda x: x["name"]), F.array().cast("array<string>")).alias("partition"))


def visual_context(addressed: DataFrame, charts: DataFrame) -> DataFrame:
    """(calculation, worksheets, charts, partition): where each calculation is shown, how, and by which dimensions in all."""
    j = addressed.join(F.broadcast(charts), "worksheet", "left")
    of = lambda c: F.array_sort(F.collect_set(c))
    return j.groupBy("calculation").agg(of("worksheet").alias("worksheets"), of("chart").alias("charts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("partition")))).alias("partition"))


def visual_of(mark: Column) -> Column:
    """The visual that shows a mark."""
    return F.coalesce(*[F.when(mark == m, v) for m, v in VISUALS.items()], F.lit("tableEx"))


def role_of(shelf: Column) -> Column:
    return F.coalesce(*[F.when(shelf == s, r) for s, r in ROLES.items()])


def grid(n: int, columns: int = 2, width: int = 1280, height: int = 720) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of n visuals in rows."""
    w, h = width // columns, height // max(1, -(-n // columns))
    return [(i % columns * w, i // columns * h, w, h) for i in range(n)]


def needs_date_table(partition: Column, order: Column) -> Column:
    """Whether a running total is one over time: a dimension is a date by its name and at most one partitions it."""
    dated = lambda c: F.exists(c, lambda x: F.lower(x).contains("date"))
    return (dated(partition) | dated(order)) & (F.size(partition) <= 1)
