"""The stateful profile runs once over a micro-batch, and counts values beyond those that stand with a key's numbers."""

import datetime

from sparkscope.streaming.stateful import kept_profiles, key_profiles


class Table:
    """Keeps the plans and the rows of its changes, which it reads twice."""

    def __init__(self):
        self.plans, self.rows = [], {}

    def merge(self, changes, order):
        self.plans.append(changes._jdf.queryExecution().toString())
        assert sorted(changes.collect()) == sorted(changes.collect())
        self.rows |= {r["key"]: r for r in changes.collect()}


def test_processor_runs_once_and_counts_many_values(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    long = "x" * 200
    batches = [[("a", at, f"v{i}", 1.0) for i in range(50)] + [("a", at, long, None)], [("a", at, f"v{i}", float("nan")) for i in range(25, 75)] + [("a", at, long, 1.0), ("b", at, None, 1.0)]]
    table = Table()
    for batch in batches:
        spark.createDataFrame(batch, "user string, at timestamp, kind string, amount double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("user string, at timestamp, kind string, amount double").parquet(f"{tmp_path}/in")
        kept_profiles(key_profiles(stream, "user", "at", "kind", "amount", 1000), table, f"{tmp_path}/checkpoint")
    assert len(table.plans) == 2 and not any("TransformWithState" in p for p in table.plans)
    assert {k: (r["rows"], r["distinct_values"], r["first_value"], r["total"]) for k, r in table.rows.items()} == {"a": (102, 76, "v0", 51.0), "b": (1, 0, None, 1.0)}
