"""The neighbour graph against brute force, copies, ties, blocks, nulls and search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import knn
from factloom.scratch import Scratch

SCHEMA = "grp string, id string, embedding array<float>"


def brute(rows, min_sim=0.8, k=5):
    seen = {}
    for g, i, v in rows:
        if g is None or i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        seen[g, i] = np.asarray(v, np.float32).astype(float)
    out = set()
    for (g, i), v in seen.items():
        near = []
        for (h, j), w in seen.items():
            if (g, i) != (h, j) and g == h and len(v) == len(w):
                sim = round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6)
                if sim >= min_sim:
                    near.append((-sim, j))
        out |= {(min(i, j), max(i, j)) for _, j in sorted(near)[:k]}
    return out


def clusters(rng, n, groups=("a", "b"), dim=24):
    rows = []
    for c in range(n):
        centre, g = rng.normal(size=dim), groups[c % len(groups)]
        for m in range(rng.integers(1, 9)):
            v = centre + rng.normal(size=dim) * 0.25
            rows.append((g, f"{g}{c:03d}-{m}", [float(x) for x in v.astype(np.float32)]))
    return rows


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_pairs_against_brute_force(spark):
    rows = clusters(np.random.default_rng(5), 40)
    got, want = pairs(knn.similar_pairs(spark.createDataFrame(rows, SCHEMA), nearest=3)), brute(rows)
    assert len(got & want) >= 0.97 * len(want) and len(want) > 80
    assert len(got & want) >= 0.97 * len(got)


def test_copies_ties_nulls_and_clashing_columns(spark):
    v, w = [1.0, 0.0, 0.5], [1.0, 0.1, 0.5]
    rows = [("g", f"c{n}", v) for n in range(9)] + [("g", "c3", v), ("g", "near", w), ("h", "other", v), ("g", "scaled", [2.0, 0.0, 1.0])]
    rows += [("g", "null", None), ("g", "empty", []), ("g", "zero", [0.0, 0.0, 0.0]), ("g", "hole", [1.0, None, 0.5]), ("g", "nan", [1.0, float("nan"), 0.5]), (None, "x", v), ("g", None, v), ("g", "short", [1.0, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit("clash"), "near": F.lit(1)})
    assert pairs(knn.similar_pairs(df)) == brute(rows)
    assert pairs(knn.similar_pairs(df.where("false"))) == set()


def recall(got, want):
    return len(got & want) / len(want)


def near(df, k):
    """The k nearest of every node by brute force."""
    rows = sorted((r.id, np.array(r.embedding, np.float32).astype(float)) for r in df.collect())
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in np.argsort(-s[i])[:k]}


def test_a_hot_leaf_is_split_and_no_task_takes_it_whole(spark):
    rng = np.random.default_rng(2)
    rows = [("g", f"v{n:03d}", [float(x) for x in np.float32(rng.normal(size=8) * 0.2 + 1)]) for n in range(400)]
    df, scratch = spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")
    coded = knn.index(df, scratch, pivots=1)
    leaves = knn._split(coded.select("grp", F.explode(F.col("near").cast("array<bigint>")).alias("leaf"), "n", "id", "hash", "code"), scratch, 60)
    assert leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 60 and leaves.select("id").distinct().count() == 400
    graph = knn.named(knn.neighbour_graph(coded, scratch, k=10, floor=0.5, block=60), coded)
    assert recall({(r.u, r.v) for r in graph.collect()}, near(df, 4)) >= 0.9  # in a cloud without any clusters


def test_one_dimension_of_many_and_copies_in_many_batches(spark):
    rows = [("g", f"d{n:02d}", [1.0] * (n % 30 + 1)) for n in range(90)] + [("h", f"c{n:03d}", [1.0, 0.5, 0.25]) for n in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert pairs(knn.similar_pairs(df)) == brute(rows)


def test_descent_makes_the_edges_that_the_seed_lacks(spark):
    rng = np.random.default_rng(4)
    rows = [("g", f"{c:03d}-{m}", [float(x) for x in np.float32(v + rng.normal(size=24) * 0.15)]) for c, v in enumerate(rng.normal(size=(60, 24))) for m in range(8)]
    df, scratch, rounds = spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), []
    coded = knn.index(df, scratch, nearest=2)
    want = {(a, b) for a, b in near(df, 5)}
    knn.neighbour_graph(coded, scratch, k=10, floor=0.5, watch=lambda g: rounds.append(recall({(r.u, r.v) for r in knn.named(g, coded).collect()}, want)))
    assert rounds[0] < 0.8 and rounds[-1] >= 0.95 and len(rounds) >= 3


def test_codes_keep_vectors_exactly():
    rng = np.random.default_rng(0)
    for v in (np.float32(np.arange(-5, 6) / 128), np.float32(rng.normal(size=11))):
        back = knn.unpack([knn.pack(v)])[0]
        assert np.allclose(back, v.astype(float) / np.linalg.norm(v.astype(float)), atol=1e-12)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_search_recall(spark, sf):
    from factloom.llm import queries

    got = {}
    for r in queries.p1_search(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for i in np.nonzero(ids % 20 == 0)[0]:
        best = [j for j in np.argsort(-np.round(x @ x[i], 6), kind="stable") if j != i][:10]
        hits += len(got[ids[i]] & set(ids[best]))
        total += 10
    assert hits / total >= 0.9


def test_search_reaches_every_small_cluster(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(600, 24))
    rows = [("g", f"{c:04d}-{m}", [float(x) for x in np.float32(v + rng.normal(size=24) * 0.1)]) for c, v in enumerate(centres) for m in range(4)]
    scratch = Scratch(spark, "t")
    coded = knn.index(spark.createDataFrame(rows, SCHEMA), scratch, nearest=3)
    graph = knn.named(knn.neighbour_graph(coded, scratch, k=8, floor=-1.0, seed=8, follow=0.6), coded)
    asked = coded.where("id like '%-0' and cast(substring(id, 1, 4) as int) % 12 = 0").select("grp", F.col("id").alias("q"), "code")
    few = {tuple(r) for r in knn.search(asked, coded, graph, scratch, k=4).select("q", "v").collect()}
    assert sum(q[:4] == v[:4] for q, v in few) >= 0.9 * 200
    monkeypatch.setattr(knn, "BROADCAST_CODES", 0)
    assert {tuple(r) for r in knn.search(asked, coded, graph, scratch, k=4).select("q", "v").collect()} == few


def test_search_of_records_against_brute_force(spark):
    from factloom.llm import queries

    sf, got = "/root/testdata/sf0.001", {}
    for r in queries.p1_search_records(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    groups = {}
    for name, kind in (("stored_fact", F.lit("fact")), ("entity", F.col("kind"))):
        for r in spark.read.parquet(f"{sf}/{name}.parquet").select(kind.alias("k"), "id", "embedding").where("k is not null").collect():
            if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding):
                groups.setdefault((name, r.k, len(r.embedding)), {})[r.id] = r.embedding
    hits = total = 0
    for rows in groups.values():
        ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i in (n for n, v in enumerate(ids) if int(v[2:], 16) % 20 == 0):
            best = [j for j in np.argsort(-np.round(x @ x[i], 6), kind="stable") if j != i][:10]
            hits += len(got.get(ids[i], set()) & set(ids[best]))
            total += len(best)
            assert ids[i] not in got.get(ids[i], set()) and len(got.get(ids[i], set())) <= 10
    assert total > 50 and hits / total >= 0.99
