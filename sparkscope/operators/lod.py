"""Level-of-detail aggregates: at a grain of their own, beside the view's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import Filter, apply_filters


def fixed(df: DataFrame, dims: list[str], aggregate: Column, name: str) -> DataFrame:
    """Adds an aggregate at the grain of dims to every row; without dims the grand total. The aggregate is joined back, small for few groups, so wide rows are not sorted into windows."""
    if not dims:
        return df.join(F.broadcast(df.agg(aggregate.alias(name))))  # one row
    keys = [f"_k{i}" for i in range(len(dims))]
    made = df.groupBy(*[F.col(d).alias(k) for d, k in zip(dims, keys)]).agg(aggregate.alias(name))
    on = [df[d].eqNullSafe(made[k]) for d, k in zip(dims, keys)]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return df.join(made, condition, "left").drop(*keys)


def exclude(view_dims: list[str], dims: list[str], aggregate_over) -> Column:
    """A window aggregate over the view's dimensions without dims; aggregate_over is an aggregate column."""
    return aggregate_over.over(Window.partitionBy(*[d for d in view_dims if d not in dims]))


def include(df: DataFrame, view_dims: list[str], dims: list[str], inner: Column, outer, name: str) -> DataFrame:
    """An aggregate at the view's dimensions and dims, then aggregated again to the view."""
    return df.groupBy(*view_dims, *[d for d in dims if d not in view_dims]).agg(inner.alias("_inner")).groupBy(*view_dims).agg(outer("_inner").alias(name))


def view(df: DataFrame, dims: list[str], measures: dict[str, Column], context: list[Filter] = (), filters: list[Filter] = (), fixed_levels: dict[str, tuple[list[str], Column]] | None = None, having: Column | None = None) -> DataFrame:
    """A view in the order of operations: context filters, FIXED aggregates, dimension filters, grouping, filters on measures."""
    df = apply_filters(df, context)
    for name, (at, aggregate) in (fixed_levels or {}).items():
        df = fixed(df, at, aggregate, name)
    df = apply_filters(df, filters)
    out = df.groupBy(*dims).agg(*[m.alias(n) for n, m in measures.items()]) if dims else df.agg(*[m.alias(n) for n, m in measures.items()])
    return out if having is None else out.where(having)
