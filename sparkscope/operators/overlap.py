"""How far columns share their values: intersections, orphans, similarity, for all pairs of columns at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import token_ratio_udf
from ..sources.shared import written
from .profile import frequencies, scalar_columns

FUZZY = 0.85
#: Pairs of values of two lengths that one character may bring together, and characters of a text that are paired with each other beyond that.
HOT_PAIRS, MOST_FIRST = 1 << 20, 16
# Characters from rare to frequent ones in names and codes; others come before them.
RARE_FIRST = "9876543210qxjzvkwyfbghmpducltsnrioae- "


def values_of(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, column, value, n) of all distinct non-null values."""
    parts = [frequencies(df, (columns or {}).get(t) or scalar_columns(df)).where("value is not null").select(F.lit(t).alias("table"), "column", "value", "n") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def pair_overlaps(values: DataFrame) -> DataFrame:
    """(table1, column1, table2, column2, exact_matches, cardinality1, cardinality2, overlap_percent, orphans1, orphans2), table1 < table2.

    Values are shuffled once. A value gathers the columns it stands in, of which there are as many as in the schemas, and
    gives a row for each pair of them; these are counted map-side. Pairs without a common value have no row.
    """
    at = values.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("table", "column"))).alias("at"))
    at = at.where(F.size("at") > 1).select("at", F.explode("at").alias("a")).select("a", F.explode("at").alias("b")).where(F.col("a.table") < F.col("b.table"))
    pairs = at.groupBy(F.col("a.table").alias("table1"), F.col("a.column").alias("column1"), F.col("b.table").alias("table2"), F.col("b.column").alias("column2")).agg(F.count("*").alias("exact_matches"))
    sizes = values.groupBy("table", "column").agg(F.count("*").alias("cardinality"))
    for k in "12":
        pairs = pairs.join(F.broadcast(sizes.select(F.col("table").alias(f"table{k}"), F.col("column").alias(f"column{k}"), F.col("cardinality").alias(f"cardinality{k}"))), [f"table{k}", f"column{k}"])
    share = F.round(F.col("exact_matches") * 100.0 / F.least("cardinality1", "cardinality2"), 4)
    return pairs.select(
        "table1", "column1", "table2", "column2", "exact_matches", "cardinality1", "cardinality2", share.alias("overlap_percent"), (F.col("cardinality1") - F.col("exact_matches")).alias("orphans1"),
        (F.col("cardinality2") - F.col("exact_matches")).alias("orphans2"),
    )


def distinct_values(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.alias("value")).where("value is not null").distinct()


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of counts for two tables of distinct values: exact_matches, orphans1, orphans2, overlap_percent, jaccard_percent."""
    both = a.select("value", F.lit(1).alias("l")).join(b.select("value", F.lit(1).alias("r")), "value", "full_outer")
    n = both.agg(F.count("l").alias("n1"), F.count("r").alias("n2"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("m"), F.count("*").alias("u"))
    percent = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x) * 100.0, y), F.lit(0.0)), 4)
    return n.select(F.col("m").alias("exact_matches"), (F.col("n1") - F.col("m")).alias("orphans1"), (F.col("n2") - F.col("m")).alias("orphans2"), percent("m", F.least("n1", "n2")).alias("overlap_percent"), percent("m", F.col("u")).alias("jaccard_percent"))


def _rarest_first(s: Column) -> Column:
    """Characters of a text, letters that are rare in names first, each with the number of equal ones before it in that order."""
    letters = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))
    ordered = F.array_sort(F.transform(letters, lambda c: F.struct(F.instr(F.lit(RARE_FIRST), F.lower(c)).alias("rank"), c.alias("c"))))
    return F.transform(ordered, lambda x, i: F.concat_ws(":", x["c"], i - F.array_position(ordered, x)))


def _partners(df: DataFrame, text: str, n: str, other: str, least: float) -> DataFrame:
    """df with a row for each length (other) that a partner may have, the text's characters (grams) and how many they have in common at least."""
    near = least / (2 - least)
    out = df.withColumn(n, F.length(text)).withColumn("grams", F.when(F.col(n) > 0, _rarest_first(F.col(text))).otherwise(F.array(F.lit(""))))
    out = out.withColumn(other, F.explode(F.sequence(F.floor(F.col(n) * near).cast("int"), F.ceil(F.col(n) / near).cast("int"))))
    common = F.greatest(F.lit(1), F.ceil((F.col(n) + F.col(other)) * (least / 2) - 1e-6).cast("int"))
    return out.withColumn("common", common).where(F.greatest(n, F.lit(1)) >= F.col("common"))


def _by_one(df: DataFrame, n: str) -> DataFrame:
    """A row for each of the first characters of which one must be in both texts."""
    return df.withColumn("gram", F.explode(F.slice("grams", 1, F.greatest(n, F.lit(1)) - F.col("common") + 1))).drop("grams", "common")


def _by_two(df: DataFrame, n: str) -> DataFrame:
    """A row for each two of the first characters of which two must be in both texts; there is one character more of these."""
    first = df.withColumn("grams", F.slice("grams", 1, F.col(n) - F.col("common") + 2))
    twos = F.flatten(F.transform("grams", lambda x, i: F.transform(F.slice("grams", i + 2, F.size("grams")), lambda y: F.concat_ws(" ", x, y))))
    return first.withColumn("gram", F.explode(twos)).drop("grams", "common")


def _alike(left: DataFrame, right: DataFrame, least: float, hot: int, also: Column | None = None) -> DataFrame:
    """(value, other, and the further columns of both) of values of left and right that are more alike than least.

    A likeness over least bounds both lengths and sets how many characters two texts have in common at least, repeats counted;
    so of each text's characters, in one fixed order, a few of the first are enough for one of them to be in both. Values meet
    by lengths and such a character, the JVM drops pairs that are too far apart by an early-ending edit distance, and only the
    rest, each pair once, is compared by common subsequence. Where a character would bring more than `hot` pairs of values of two
    lengths together, those of these lengths meet by two characters instead, of which one more of the first must be looked at.
    """
    tokens = lambda c: F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != "")), " ")
    left = _partners(left.withColumn("s", tokens(F.col("value"))), "s", "n", "m", least)
    right = _partners(right.withColumnRenamed("value", "other").withColumn("t", tokens(F.col("other"))), "t", "m", "n", least)
    on = ["n", "m", "gram"]
    count = lambda df, n, k: _by_one(df.select("n", "m", "grams", "common"), n).groupBy(*on).agg(F.count("*").alias(k))
    two = (F.col("common") >= 2) & (F.greatest("n", "m") - F.col("common") + 2 <= MOST_FIRST)
    full = count(left.where(two), "n", "x").join(count(right.where(two), "m", "y"), on).where(F.col("x") * F.col("y") > hot).select("n", "m").distinct()
    crowded = written(full, "crowded")  # two lengths a row
    few, many = (lambda df: df.join(crowded, ["n", "m"], "left_anti")), (lambda df: df.join(crowded, ["n", "m"], "left_semi"))
    most = ((1 - least) * (F.col("n") + F.col("m"))).cast("int")
    # Half the edits suffice where letters are exchanged, so the edit distance never exceeds this bound.
    close = F.levenshtein("s", "t") <= most
    if also is not None:
        close = also & close
    met = _by_one(few(left), "n").join(_by_one(few(right), "m"), on).where(close).unionByName(_by_two(many(left), "n").join(_by_two(many(right), "m"), on).where(close))
    return met.drop(*on, "s", "t").dropDuplicates(["value", "other"]).where(token_ratio_udf("value", "other") > least)


def fuzzy_matches(a: DataFrame, b: DataFrame, least: float = FUZZY, hot: int = HOT_PAIRS) -> DataFrame:
    """Values of a, not in b, for which b has an unmatched value more alike than least, each once."""
    left, right = a.select("value").join(b, "value", "left_anti"), b.select("value").join(a, "value", "left_anti")
    return _alike(left, right, least, hot).select("value").distinct()


def fuzzy_pairs(values: DataFrame, pairs: DataFrame, least: float = FUZZY, hot: int = HOT_PAIRS) -> DataFrame:
    """(table1, column1, table2, column2, fuzzy_matches) for pairs of columns: values of the first, not in the second, that some unmatched value of the second is like.

    All pairs share one index. A text is in it once, with the pairs whose first and whose second column alone hold it, of which
    there are as many as the schemas give; two texts are compared once, if some pair has the one on the left and the other
    on the right. Pairs without such values have no row; null values are like nothing.
    """
    ends = ["table1", "column1", "table2", "column2"]
    keyed = pairs.select(*ends).distinct().withColumn("pair", F.concat_ws("\x01", *ends))
    side = lambda k: F.struct(F.col(f"table{k}").alias("table"), F.col(f"column{k}").alias("column"), F.col("pair"), F.lit(k).alias("side"))
    sides = keyed.select(F.inline(F.array(side(1), side(2))))
    of = lambda k: F.collect_set(F.when(F.col("side") == k, F.col("pair")))
    at = values.where("value is not null").join(F.broadcast(sides), ["table", "column"]).groupBy("value").agg(of(1).alias("x"), of(2).alias("y"))
    at = written(at.select("value", F.array_except("x", "y").alias("on_left"), F.array_except("y", "x").alias("on_right")), "fuzzy-values")
    left, right = at.where(F.size("on_left") > 0).drop("on_right"), at.where(F.size("on_right") > 0).drop("on_left")
    found = _alike(left, right, least, hot, F.arrays_overlap("on_left", "on_right")).select("value", F.explode(F.array_intersect("on_left", "on_right")).alias("pair")).distinct()
    return found.groupBy("pair").agg(F.count("*").alias("fuzzy_matches")).join(F.broadcast(keyed), "pair").select(*ends, "fuzzy_matches")
