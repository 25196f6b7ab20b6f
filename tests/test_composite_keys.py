"""Keys of several columns are counted in as many partitions as there are rows, exactly also where hashes repeat."""

from sparkscope.operators import profile as P


def test_partitions_grow_with_rows_and_repeated_keys_are_found(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 100)
    made = []
    dealt = P.dealt
    monkeypatch.setattr(P, "dealt", lambda df, rows, *by: made.append(dealt(df, rows, *by)) or made[-1])
    for n in (500, 2000):
        made.clear()
        unique = spark.range(n).selectExpr("id div 20 as a", "id % 20 as b", "id % 7 as c")
        assert [tuple(r["columns"]) for r in P.composite_keys(unique, ["a", "b", "c"]).collect()] == [("a", "b")]
        assert made[0].rdd.getNumPartitions() == n // 100
        once_more = unique.union(unique.where("a = 3 and b = 4"))
        assert P.composite_keys(once_more, ["a", "b"]).collect() == []
    nulls = spark.createDataFrame([(None, 1), (None, 2), (1, None), (1, 1)], "a int, b int")
    assert [tuple(r["columns"]) for r in P.composite_keys(nulls, ["a", "b"]).collect()] == [("a", "b")]
