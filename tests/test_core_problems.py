"""Hierarchies, histories and instants: brute force on small rows, and the edge cases of their docstrings."""

import random
from datetime import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import hierarchy, history, instants

SF = "/root/testdata/sf0.001"


def brute_hierarchy(edges):
    parent, nodes = {}, set()
    for child, up in edges:
        nodes |= {child, up}
        parent[child] = min(parent.get(child, up), up)
    kids = {}
    for c, p in parent.items():
        kids.setdefault(p, []).append(c)
    out = {}
    for n in nodes:
        path, x, seen = [n], n, {n}
        while x in parent and parent[x] not in seen:
            x = parent[x]
            seen.add(x)
            path.append(x)
        below, todo = set(), [n]
        while todo:
            for c in kids.get(todo.pop(), []):
                if c not in below:
                    below.add(c)
                    todo.append(c)
        below.discard(n)
        if x in parent:
            loop, y = [parent[x]], parent[parent[x]]
            while y != loop[0]:
                loop.append(y)
                y = parent[y]
            out[n] = (min(loop), -1 if n in loop else -2, "", len(below))
        else:
            out[n] = (x, len(path) - 1, ">".join(reversed(path)), len(below))
    return out


def rows_of(df):
    return {r.node_id: tuple(r)[1:] for r in df.collect()}


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    edges = [(f"n{i}", f"n{rng.randrange(max(1, i))}") for i in range(1, 40)]  # a tree
    edges += [(f"c{i}", f"c{i + 1}") for i in range(25)]  # a chain
    edges += [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("x", "l2"), ("y", "x"), ("z", "x"), ("a", "b"), ("b", "a")]  # loops and what hangs below
    got = rows_of(hierarchy.hierarchy(spark.createDataFrame(edges, "id string, parent string")))
    assert got == brute_hierarchy(edges)


def test_hierarchy_cleaning_and_edge_cases(spark):
    rel = spark.createDataFrame(
        [(" A ", "b", "Part_Of "), ("b", "a", "HAS-PART"), ("a", "b", "part of"), ("b", "b", "part_of"), ("a", "q", "related"), (None, "b", "part_of"), ("c", None, "part_of"),
         ("c", "b", None), ("d", "z", "part_of"), ("d", "y", "part_of"), ("", "b", "part_of")],
        "src string, dst string, kind string",
    ).withColumn("id", F.lit("clash"))
    got = rows_of(hierarchy.hierarchy(hierarchy.part_edges(rel)))
    assert got == {"a": ("b", 1, "b>a", 0), "b": ("b", 0, "b", 1), "d": ("y", 1, "y>d", 0), "y": ("y", 0, "y", 1)}
    assert hierarchy.hierarchy(hierarchy.part_edges(rel.where("false"))).count() == 0


def test_descendants(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "b"), ("l1", "l2"), ("l2", "l1"), ("x", "l1"), ("y", "x")]
    got = {tuple(r) for r in hierarchy.descendants(spark.createDataFrame(edges, "id string, parent string")).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1), ("x", "y", 1)}


def test_intermediate_tables_can_be_released(spark):
    import os

    from factloom import scratch

    folder = scratch.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert rows_of(hierarchy.hierarchy(spark.createDataFrame([("b", "a")], "id string, parent string")))
    assert set(os.listdir(folder)) - before
    scratch.release(spark)
    assert not set(os.listdir(folder)) - before


def test_hierarchy_deeper_than_any_round_count(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(1500)] + [(f"s{i}", "n0700") for i in range(300)]
    got = rows_of(hierarchy.hierarchy(spark.createDataFrame(chain, "id string, parent string"), together=2))
    assert got == brute_hierarchy(chain)


OBS = "id string, base_id string, claim_entity string, claim_attribute string, valid_at timestamp_ntz, invalid_at timestamp_ntz, created_at timestamp_ntz, expired_at timestamp_ntz, version_id string"


def obs(spark, rows):
    return spark.createDataFrame([(i, b, e, a, v, w, c, x, "clash") for i, b, e, a, v, w, c, x in rows], OBS)


def us(*a):
    return int((dt(*a) - dt(1970, 1, 1)).total_seconds() * 1_000_000)


def test_history_rules(spark):
    d = lambda n: dt(2025, 1, n)
    rows = [
        ("1", "A", "e", "x", d(1), None, d(1), None), ("2", "A", "e", "x", d(3), d(5), d(3), None),  # adjoining: one version
        ("3", "B", "e", "x", d(5), None, d(5), None), ("3", "B", "e", "x", d(5), None, d(5), None),  # begins at its end; delivered twice
        ("4", "A", "e", "x", d(9), d(10), d(9), None),  # A again: episode 1; then a gap
        ("5", "A", "e", "x", d(12), None, None, None), ("6", "C", "e", "x", d(12), None, d(1), None),  # tie: a null created_at is earliest
        ("7", "Z", "e", "x", d(2), None, d(2), d(3)), ("8", "Z", "e", "x", None, None, d(2), None), ("9", "Z", "e", "x", d(4), d(4), d(2), None),  # do not count
        ("a", "Z", None, "x", d(1), None, d(1), None), ("b", None, "e", "x", d(1), None, d(1), None),
    ]
    want = {("A", us(2025, 1, 1), us(2025, 1, 5), "B"), ("B", us(2025, 1, 5), us(2025, 1, 9), "A.1"), ("A.1", us(2025, 1, 9), us(2025, 1, 10), ""), ("C", us(2025, 1, 12), -1, "")}
    for hot in (200_000, 2):
        assert {tuple(r) for r in history.versions(obs(spark, rows), hot_rows=hot, slices=3).collect()} == want
    assert history.versions(obs(spark, rows).where("false")).count() == 0


def test_history_hot_claim_is_sliced_alike(spark):
    rng = random.Random(1)
    rows = [(f"f{n}", f"b{rng.randrange(4)}", "e" if n % 3 else f"e{n % 7}", "x", dt(2025, 1 + rng.randrange(12), 1 + rng.randrange(28)), None, dt(2025, 1, 1), None) for n in range(300)]
    df = obs(spark, rows)
    plain = sorted(map(tuple, history.versions(df).collect()))
    assert plain == sorted(map(tuple, history.versions(df, hot_rows=30, slices=6).collect()))
    assert len(plain) > 50


def test_history_flapping_value_of_a_hot_claim(spark):
    rows = [(f"f{n:03d}", "A" if n % 2 else "B", "e", "x", dt(2024, 1 + n // 28, 1 + n % 28), None, dt(2025, 1, 1), None) for n in range(200)]
    rows += [(f"g{n}", "C", "e2", "x", dt(2024, 1, 1 + n), None, dt(2025, 1, 1), None) for n in range(5)]
    df = obs(spark, rows)
    plain = sorted(map(tuple, history.versions(df).collect()))
    assert plain == sorted(map(tuple, history.versions(df, hot_rows=20, slices=7).collect()))
    assert {v for v, *_ in plain} == {"C"} | {b + (f".{n}" if n else "") for b in "AB" for n in range(100)}


CASES = [
    ("2024-08-04T02:21:31+02:00", (2024, 8, 4, 0, 21, 31)), ("2024-08-04 02:21:31.9999999 UTC", (2024, 8, 4, 2, 21, 31, 999999)), ("05/04/24 1:07 p.m.", (2024, 4, 5, 11, 7)),
    ("2024-03-31 02:30", (2024, 3, 31, 1, 30)), ("2024-10-27 02:30", (2024, 10, 27, 0, 30)), ("2024-10-27 02:30 CET", (2024, 10, 27, 1, 30)), ("2024-10-27T02:30:00 (Europe/Berlin)", (2024, 10, 27, 0, 30)),
    ("3. März 2025, 08:05 Uhr", (2025, 3, 3, 7, 5)), ("Sat, 17 Aug 2024 05:45:13 +0200", (2024, 8, 17, 3, 45, 13)), ("Jan 8, 2026, 12:05 am", (2026, 1, 7, 23, 5)), ("20240711", (2024, 7, 10, 22)),
    ("2025-214T04:24:35Z", (2025, 8, 2, 4, 24, 35)), ("1703164241", (2023, 12, 21, 13, 10, 41)), ("1703164241000", (2023, 12, 21, 13, 10, 41)), ("1703164241.5", (2023, 12, 21, 13, 10, 41, 500000)),
    ("“2024-02-29”", (2024, 2, 28, 23)), ("2025-02-29", None), ("2024-13-01", None), ("31/04/2024 10:00", None), ("2024-01-01 24:00", None), ("2025-07", None), ("last Tuesday", None), ("", None), (None, None),
    ("13/25/2024 10:00", None), ("2024-05-01 10:00 Mars/Base", None), ("x" * 5000, None), ("2024-366T00:00:00Z", (2024, 12, 31, 0, 0)), ("2025-366T00:00:00Z", None), ("0:00 2024", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(n, v, "Europe/Berlin", "dmy", "clash") for n, (v, _) in enumerate(CASES)], "n int, value string, tz string, date_order string, zone string")
    got = {r.n: r.utc_us for r in instants.utc_micros(df).collect()}
    for n, (text, want) in enumerate(CASES):
        assert got[n] == (None if want is None else us(*want[:6]) + (want[6] if len(want) > 6 else 0)), text


def test_instants_long_texts_numbers_and_policies(spark):
    texts = [(" " * 500 + "2024-01-01Z" + " " * 500, us(2024, 1, 1)), ("2024-01-01T00:00:00." + "1" * 300 + "Z", us(2024, 1, 1) + 111111), ("1703164241000000999", 1703164241000000), ("-1703164241", -1703164241000000),
             ("1703164241.9999999999999", 1703164241999999), ("12345678", None), ("17", None)]
    df = spark.createDataFrame([(n, v, "UTC", None) for n, (v, _) in enumerate(texts)], "n int, value string, tz string, date_order string")
    assert {r.n: r.utc_us for r in instants.utc_micros(df).collect()} == {n: want for n, (_, want) in enumerate(texts)}
    local = spark.createDataFrame([(1, "2024-10-27 02:30", "Europe/Berlin", None), (2, "2024-03-31 02:30", "Europe/Berlin", None), (3, "2024-07-01 02:30", "Europe/Berlin", None)], "n int, value string, tz string, date_order string")
    got = lambda **p: {r.n: r.utc_us for r in instants.utc_micros(local, **p).collect()}
    july = us(2024, 7, 1, 0, 30)
    assert got() == {1: us(2024, 10, 27, 0, 30), 2: us(2024, 3, 31, 1, 30), 3: july}
    assert got(twice="second", skipped="after") == {1: us(2024, 10, 27, 1, 30), 2: us(2024, 3, 31, 0, 30), 3: july}
    assert got(twice="none", skipped="none") == {1: None, 2: None, 3: july}
    with pytest.raises(ValueError):
        got(twice="third")


def test_instants_registry_rules(spark):
    reg = spark.createDataFrame(
        [(1, "s", "ticket", "04/05/2024 10:00", "2024-01-01"), (1, "s", "ticket", "04/05/2024 10:00", "2024-01-01"), (2, "s", "wiki", "2024-01-01", "2024-01-01"), (3, "?", "wiki", None, "2024-01-01"),
         (4, "?", "wiki", None, "2024-01-01Z"), (None, "s", "wiki", None, "2024-01-01")],
        "reg_id bigint, source_id string, kind string, version string, lastmodified string",
    ).withColumn("tz", F.lit("Mars/Base"))
    sites = spark.createDataFrame([("s", "UTC", "mdy")], "id string, tz string, date_order string")
    got = {(r.reg_id, r.field): r.utc_us for r in instants.registry_instants(reg.drop("tz"), sites).collect()}
    day = us(2024, 1, 1)
    assert got == {(1, "version"): us(2024, 4, 5, 10), (1, "lastmodified"): day, (2, "lastmodified"): day, (4, "lastmodified"): day}
    assert instants.registry_instants(reg.drop("tz").where("false"), sites).count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p3_descendants", "p4_found"])
def test_found_queries_against_sql(spark, name):
    from factloom.plans import problems

    con = duckdb.connect()
    for t in ("entity_relation", "stored_fact"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(problems.ORACLE[name])
    got = problems.QUERIES[name](spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
