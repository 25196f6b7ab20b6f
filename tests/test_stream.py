"""A stateful stream over several micro-batches against plain loops."""

import datetime

from sparkscope.sources.state_table import StateTable
from sparkscope.streaming.stateful import kept_profiles, key_profiles

SCHEMA = "user string, at timestamp, kind string, amount double"


def brute(batches, late):
    state = {}
    for batch in batches:
        before = {k: s["last_at"] for k, s in state.items()}
        for user, at, kind, amount in batch:
            s = state.setdefault(user, {"rows": 0, "late": 0, "kinds": set(), "first": None, "last_at": None, "total": 0.0})
            if at is None or before.get(user) is not None and at < before[user] - late:
                s["late"] += 1
                continue
            s["rows"], s["total"] = s["rows"] + 1, s["total"] + (amount or 0)
            s["kinds"] |= {kind} - {None}
            s["first"] = min(s["first"] or (at, kind is None, kind or ""), (at, kind is None, kind or ""))
            s["last_at"] = at if s["last_at"] is None else max(s["last_at"], at)
    return {k: (s["rows"], s["late"], len(s["kinds"]), s["first"] and s["first"][0], s["first"] and (None if s["first"][1] else s["first"][2]), s["last_at"], round(s["total"], 6)) for k, s in state.items()}


def test_micro_batches_keep_exact_profiles_and_late_rows_apart(spark, tmp_path):
    t = lambda minute: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)
    batches = [
        [("a", t(0), "x", 1.0), ("a", t(30), "y", None), ("b", t(5), None, 2.5), (None, t(1), "x", 1.0)],
        [("a", t(25), "x", 2.0), ("a", t(1), "z", 9.0), ("a", None, "z", 9.0), ("c", t(-500), "q", 0.5), ("b", t(5), "w", 1.0)],
        [("a", t(60), "z", 1.0), ("b", t(4), "w", 1.0), (None, t(2), None, None), (None, t(-100), "late", 1.0)],
    ]
    late, table = datetime.timedelta(minutes=10), StateTable(spark, f"file://{tmp_path}/t", ["key"], 4)
    for n, batch in enumerate(batches, 1):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        kept_profiles(key_profiles(stream, "user", "at", "kind", "amount", int(late.total_seconds() * 1000)), table, f"{tmp_path}/checkpoint")
        rows = table.read().selectExpr("*", "cast(first_at as timestamp_ntz) as f", "cast(last_at as timestamp_ntz) as l").collect()
        assert {r["key"]: (r["rows"], r["late"], r["distinct_values"], r["f"], r["first_value"], r["l"], round(r["total"], 6)) for r in rows} == brute(batches[:n], late)
