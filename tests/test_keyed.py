"""Tables rewritten by key and read page by page."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kpivane.sources import store as st
from kpivane.sources.keyed import KeyedTable, TimeTable


def folders(path):
    return {name: sorted(os.listdir(f"{path}/{name}")) for name in os.listdir(path) if "=" in name}


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("k", "v", "at").collect())


def test_a_change_rewrites_only_its_folders(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 8)
    table.create(spark.createDataFrame([(f"k{i}", i, 1) for i in range(200)], "k string, v int, at int"))
    before = folders(table.path)
    assert len(before) == 8
    incoming = spark.createDataFrame([("k3", 33, 2), ("k3", 34, 1), ("new", 7, 0)], "k string, v int, at int")
    for _ in range(2):  # a repeated change gives the same rows
        touched = table.change(incoming, lambda a, b: st.upsert(a, b, ["k"], F.desc("at")))
        want = {f"k{i}": (i, 1) for i in range(200)} | {"k3": (33, 2), "new": (7, 0)}
        assert rows_of(table.read()) == sorted((k, v, at) for k, (v, at) in want.items())
    after = folders(table.path)
    assert 1 <= len(touched) <= 2 and {n for n in after if after[n] != before[n]} == {f"bucket={b}" for b in touched}
    assert table.change(incoming.limit(0), st.upsert) == []


def test_rows_of_keys_are_replaced_and_folders_can_become_empty(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.create(spark.createDataFrame([("a", i, 1) for i in range(3)] + [("b", 9, 1), (None, 5, 1)], "k string, v int, at int"))
    fresh = spark.createDataFrame([("a", 100, 2), ("z", 1, 1)], "k string, v int, at int")
    table.replace(spark.createDataFrame([("a",), ("gone",)], "k string"), fresh)
    assert {(r.k, r.v) for r in table.read().collect()} == {("a", 100), ("b", 9), (None, 5)}
    table.replace(spark.createDataFrame([("a",), ("b",)], "k string"), fresh.limit(0))
    assert {(r.k, r.v) for r in table.read().collect()} == {(None, 5)}
    empty = KeyedTable(spark, str(tmp_path / "e"), ["k"], 4)
    empty.create(fresh.limit(0))
    empty.change(fresh, lambda a, b: st.upsert(a, b, ["k"], F.desc("at")))
    assert rows_of(empty.read()) == [("a", 100, 2), ("z", 1, 1)]


def test_pages_follow_one_another(spark, tmp_path):
    table = TimeTable(spark, str(tmp_path / "t"), "at", "id")
    start = datetime(2024, 1, 1)
    rows = [(f"{i:03d}", start + timedelta(days=i // 3), "x" if i % 10 == 0 else "y") for i in range(300)]
    table.append(spark.createDataFrame(rows[:200], "id string, at timestamp, kind string"))
    table.append(spark.createDataFrame([*rows[200:], ("lost", None, "x")], "id string, at timestamp, kind string"))
    for where, wanted, size in ((None, rows, 70), (F.col("kind") == "x", [r for r in rows if r[2] == "x"], 7)):
        ordered = sorted(wanted, key=lambda r: (-r[1].timestamp(), r[0]))
        seen, last = [], None
        while page := table.page_after(size, last, where).collect():
            seen += [(r.id, r.at, r.kind) for r in page]
            last = (page[-1].at, page[-1].id)
        assert seen == ordered
    plan = table.page_after(10, (datetime(2024, 2, 10), "100"))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PartitionFilters" in plan and "Sort [" not in plan.split("== Physical Plan ==")[1]
    assert table.page_after(10, (datetime(2000, 1, 1), "a")).count() == 0
