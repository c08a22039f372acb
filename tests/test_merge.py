"""Batches merged into a keyed table at once, against one row after another; only partitions that changed are written."""

import os
import random

import pytest
from pyspark.sql import functions as F

from florilege.operators import merge

SCHEMA = "key string, issue int, section int, text string"


def one_by_one(old, new, anew):
    """State and republications after the batch, and what became of each row."""
    going = {r[0]: r for r in old if (r[1], r[2]) in anew}
    state = {r[0]: r for r in old if r[0] not in going}
    again = {}
    for key, issue, section, text, _ in sorted(new, key=lambda r: r[4]):
        row = (key, issue, section, text)
        if key in state and state[key][1] != issue:
            again[key, issue] = row
        else:
            state[key] = row
    told = {(*r, "republished") for r in again.values()}
    before = {r[0]: r for r in old}
    for key, row in state.items():
        was = before.get(key)
        brought = any(r[0] == key and r[1] == row[1] for r in new)
        told.add((*row, "kept" if not brought else "inserted" if was is None or was[1] != row[1] else "same" if was == row else "replaced"))
    told |= {(*r, "deleted") for r in going.values() if r[0] not in state or state[r[0]][1] != r[1]}
    return state, told


@pytest.mark.parametrize("seed", range(4))
def test_changes_are_those_of_single_steps(spark, seed):
    rng = random.Random(seed)
    row = lambda k: (f"k{k}", rng.randrange(4), rng.randrange(2), rng.choice("abc"))
    old = [row(k) for k in range(30)]
    new = [(*rng.choice([row(rng.randrange(45)), rng.choice(old)]), n) for n in range(40)]
    anew = {(rng.randrange(4), rng.randrange(2)) for _ in range(2)}
    state, told = one_by_one(old, new, anew)
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA + ", n int")
    changed = merge.changes(a, b, "key", "issue", ["n"], spark.createDataFrame(sorted(anew), "issue int, section int")).cache()
    rows = [tuple(r) for r in changed.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == told
    assert {tuple(r) for r in merge.state(changed).collect()} == set(state.values())
    made = lambda rows: rows.select(F.col("key").alias("of"), F.length("text").alias("size"), "text")
    parts = merge.dependants(made(a), changed, "key", made(merge.fresh(changed)), "of")
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, made(merge.state(changed)).collect()))


def test_without_sections_and_with_empty_tables(spark):
    old, new = spark.createDataFrame([("a", 1, 1, "x")], SCHEMA), spark.createDataFrame([("a", 2, 1, "y", 0), ("b", None, 1, None, 1)], SCHEMA + ", n int")
    of = lambda a, b: {(r["key"], r["issue"], r["change"]) for r in merge.changes(a, b, "key", "issue", ["n"]).collect()}
    assert of(old, new) == {("a", 1, "kept"), ("a", 2, "republished"), ("b", None, "inserted")}
    assert of(old.limit(0), new) == {("a", 2, "inserted"), ("b", None, "inserted")} and of(old, new.limit(0)) == {("a", 1, "kept")}


def test_only_groups_that_changed_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(f"k{i}", i % 5, 0, "x") for i in range(50)], SCHEMA)
    old.write.partitionBy("issue").parquet(path)
    files = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("issue")}
    before = files()
    new = spark.createDataFrame([("k1", 1, 0, "new", 0), ("k2", 3, 0, "elsewhere", 1), ("k8", 3, 0, "x", 2), ("z", 7, 0, "x", 3)], SCHEMA + ", n int")
    known = spark.read.parquet(path).select("key", "issue", "section", "text")
    changed = merge.changes(known, new, "key", "issue", ["n"], spark.createDataFrame([(4, 0)], "issue int, section int"))
    assert merge.write(changed, path, "issue") == [1, 4, 7]
    after = files()
    assert all(after[f"issue={k}"] == before[f"issue={k}"] for k in (0, 2, 3)) and after["issue=1"] != before["issue=1"] and "issue=4" not in after
    got = {(r["key"], r["text"]) for r in spark.read.parquet(path).collect()}
    assert got == {(f"k{i}", "new" if i == 1 else "x") for i in range(50) if i % 5 != 4} | {("z", "x")}


def test_republications_take_the_place_of_earlier_ones(spark):
    before = spark.createDataFrame([("a", 2, "old"), ("b", 2, "old")], "key string, issue int, text string")
    changed = spark.createDataFrame([("a", 2, 0, "new", "republished"), ("a", 3, 0, "new", "republished"), ("a", 1, 0, "x", "kept")], SCHEMA + ", change string")
    assert {tuple(r) for r in merge.republications(before, changed, "key", "issue").collect()} == {("a", 2, "new"), ("a", 3, "new"), ("b", 2, "old")}
