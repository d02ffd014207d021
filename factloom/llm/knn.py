"""Most similar vectors for every vector: a neighbour graph built by NN-descent, and greedy search in it.

Rows are compared only within their group. The graph starts from a few edges of every vector (its two closest ones in the
leaf of each of its nearest pivots) instead of random edges, as random edges between small, far clusters never lead into
them; then rounds of NN-descent join neighbours with neighbours of neighbours and keep what is closer, until hardly an
edge changes. Vectors travel as compact codes, scores are exact cosines in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.scratch import Scratch
from factloom.session import spread

#: Equal similarity means equal after rounding to this many digits.
DIGITS = 6
#: Candidate pairs are broadcast to the vectors where they are at most this many and at most this share of them; else both are shuffled.
BROADCAST_PAIRS, BROADCAST_SHARE = 20_000, 0.05
#: Query vectors of up to this many bytes of codes are broadcast to the vectors they are compared with.
BROADCAST_CODES = 8_000_000


def pack(vector: np.ndarray) -> bytes:
    """A vector without loss: int8 steps of a power of two where that is exact, else float32."""
    for shift in (7, 6, 5, 8, 9, 10):
        scaled = vector * np.float32(2.0**shift)
        whole = np.rint(scaled)
        if np.abs(whole).max() <= 127 and np.array_equal(whole, scaled):
            return bytes([shift]) + whole.astype(np.int8).tobytes()
    return bytes([255]) + vector.astype("<f4").tobytes()


def unpack(codes: list[bytes]) -> np.ndarray:
    """Vectors of equal dimension, unit length, as rows of float64."""
    dims = {(len(c) - 1) // (4 if c[0] == 255 else 1) for c in codes}
    (dim,) = dims
    if all(c[0] != 255 for c in codes):
        whole = np.frombuffer(b"".join(codes), dtype=np.int8).reshape(len(codes), dim + 1)
        out = whole[:, 1:].astype(np.float64)
    else:
        out = np.empty((len(codes), dim))
        for i, c in enumerate(codes):
            out[i] = np.frombuffer(c, dtype="<f4", offset=1) if c[0] == 255 else np.frombuffer(c, dtype=np.int8, offset=1)
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out


_CODED = pa.schema([("grp", pa.string()), ("id", pa.string()), ("hash", pa.binary()), ("code", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grp, ids, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        holes = np.zeros(len(flat), bool) if not flat.null_count else np.asarray(flat.is_null())
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32)
        out: list[list] = [[], [], [], []]
        at = 0
        for g, i, n in zip(grp, ids, lengths):
            v = values[at : at + n]
            bad = not n or holes[at : at + n].any() or not np.isfinite(v).all() or not v.any()
            at += n
            if bad:
                continue
            code = pack(v)
            for column, value in zip(out, (f"{g}\x1f{n}", i, hashlib.blake2b(code, digest_size=16).digest(), code)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CODED.types)], schema=_CODED)


def encode(rows: DataFrame, grp: str = "grp", id: str = "id", embedding: str = "embedding") -> DataFrame:
    """``grp, id, hash, code`` of the rows whose vector can be compared.

    Rows without group or id and vectors that are null, empty, all zero or hold nulls, NaN or infinities take no part.
    Vectors of different dimension are in different groups.
    """
    ready = rows.where(F.col(grp).isNotNull() & F.col(id).isNotNull() & (F.size(embedding) > 0))
    ready = ready.select(F.col(grp).cast("string"), F.col(id).cast("string"), F.col(embedding).cast("array<float>"))
    return spread(ready).mapInArrow(_encode, "grp string, id string, hash binary, code binary")


def _pivots(coded: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Pivot vectors by dimension: a bounded sample of ``count`` rows, by the smallest hashes of their ids."""
    sample = coded.select("code").orderBy(F.xxhash64("id", F.lit(17)), "id").limit(count).collect()
    by_dim: dict[int, list[bytes]] = {}
    for row in sample:
        c = bytes(row["code"])
        by_dim.setdefault((len(c) - 1) // (4 if c[0] == 255 else 1), []).append(c)
    return {dim: unpack(sorted(set(codes))) for dim, codes in by_dim.items()}


def _closeness(codes: list[bytes], pivots: np.ndarray) -> np.ndarray:
    """Cosines of coded vectors with unit pivots, the same for a code whatever others come with it: sums in another order differ beyond the digits kept."""
    return np.round(unpack(codes) @ pivots.T, 9)


def index(rows: DataFrame, scratch: Scratch, pivots: int | None = None, nearest: int = 2, spill: float = 0.9, max_pivots: int = 8192) -> DataFrame:
    """The written table ``grp, id, hash, code, n, near``: every comparable vector, numbered, with the leaves of its nearest pivots.

    ``pivots`` defaults to the square root of the row count (at most ``max_pivots``, which bounds what is sampled and
    broadcast), so a leaf grows as slowly as the number of leaves. A vector goes to its ``nearest`` leaves, and to one more
    where that pivot is nearly (``spill``) as close as the closest: only there could a near vector have gone elsewhere. Of copies
    that come in one batch only the smallest id is sent to leaves (the others have none), so a mass of copies never meets in one
    leaf; which leaves depends on the code alone, whatever batch it comes in.
    """
    coded = scratch.save(encode(rows).withColumn("n", F.monotonically_increasing_id()), "coded")
    count = pivots or int(min(max_pivots, max(16, coded.count() ** 0.5)))
    table = coded.sparkSession.sparkContext.broadcast(_pivots(coded, count))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, ids, hashes, codes = (batch.column(c).to_pylist() for c in ("grp", "id", "hash", "code"))
            first: dict[tuple, int] = {}
            for n, key in enumerate(zip(grp, hashes)):
                if key not in first or ids[n] < ids[first[key]]:
                    first[key] = n
            near: list[list[int]] = [[] for _ in ids]
            by_dim: dict[int, list[int]] = {}
            for n in first.values():
                by_dim.setdefault((len(codes[n]) - 1) // (4 if codes[n][0] == 255 else 1), []).append(n)
            for dim, at in by_dim.items():
                pivot = table.value.get(dim)
                found = [[0, 1]] * len(at)  # too few pivots: two leaves of all, which are split apart
                if pivot is not None and len(pivot) > 1:
                    closeness = _closeness([codes[n] for n in at], pivot)
                    m = min(nearest + 1, closeness.shape[1])
                    top = np.argpartition(-closeness, m - 1, axis=1)[:, :m]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(closeness, top, axis=1), axis=1), axis=1)
                    reach = np.take_along_axis(closeness, top, axis=1)
                    more = reach[:, -1] >= spill * reach[:, 0]
                    found = [leaf if wide else leaf[:nearest] for leaf, wide in zip(top.tolist(), more)]
                for n, leaf in zip(at, found):
                    near[n] = leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    out = scratch.save(coded.mapInArrow(assign, "grp string, id string, hash binary, code binary, n bigint, near array<int>"), "index")
    scratch.drop(coded)
    return out


def _leaf_edges(k: int, floor: float):
    """Per run of rows of one leaf: the k best edges of every vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: dict[bytes, tuple[str, int, bytes]]) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            number = np.array([n for _, n, _ in rows.values()])
            exact = unpack([c for _, _, c in rows.values()])
            fast = exact.astype(np.float32)
            left, right = [], []
            for at in range(0, len(number), 1024):
                part = fast[at : at + 1024] @ fast.T
                part[np.arange(part.shape[0]), np.arange(at, at + part.shape[0])] = -2
                if part.shape[1] > 4 * k:
                    limit = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] - 1e-5
                    a, b = np.nonzero(part >= np.maximum(limit, floor - 1e-5)[:, None])
                else:
                    a, b = np.nonzero(part >= floor - 1e-5)
                left.append(a + at)
                right.append(b)
            a, b = np.concatenate(left), np.concatenate(right)
            if not len(a):
                return None
            sim = np.concatenate([np.einsum("ij,ij->i", exact[a[s : s + 65536]], exact[b[s : s + 65536]]) for s in range(0, len(a), 65536)])
            # Of a small leaf all edges are there: the best k of each are kept, with ties.
            order = np.lexsort((-sim, a))
            a, b, sim = a[order], b[order], np.round(sim[order], DIGITS)
            starts = np.searchsorted(a, np.arange(len(number)))
            kth = np.minimum(starts[a] + k - 1, np.append(starts, len(a))[a + 1] - 1)
            keep = (sim >= floor) & (sim >= sim[kth])
            a, b, sim = a[keep], b[keep], sim[keep]
            return pa.RecordBatch.from_arrays([pa.array(number[a]), pa.array(number[b]), pa.array(sim)], names=["u", "v", "sim"])

        key, rows = None, {}
        for batch in batches:
            for g, leaf, n, i, h, c in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (g, leaf) != key:
                    if rows and (out := close(rows)) is not None:
                        yield out
                    key, rows = (g, leaf), {}
                old = rows.get(h)
                if old is None or (i, n) < old[:2]:
                    rows[h] = (i, n, c)
        if rows and (out := close(rows)) is not None:
            yield out

    return work


def _split(leaves: DataFrame, scratch: Scratch, block: int, pivots: int = 65_536) -> DataFrame:
    """Leaves (``grp, leaf, n, id, hash, code``) of at most about ``block`` rows: larger ones are split by pivots of their own, again and again.

    A pass takes the largest leaves (an eighth of ``pivots`` of them at most) and at most ``pivots`` sampled rows, which bounds what is
    collected and broadcast. Every row of a split leaf goes to its nearest pivot; what a border parts, the descent joins.
    """
    last = None
    while True:
        big = leaves.groupBy("grp", "leaf").count().where(F.col("count") > block).orderBy(F.desc("count"), "grp", "leaf").limit(pivots // 8).collect()
        sizes = {(r["grp"], r["leaf"]): r["count"] for r in big}
        if not big or sizes == last:  # what no pivot divides
            return leaves
        each = max(2, min(64, pivots // len(big)))
        chosen = leaves.sparkSession.createDataFrame([(g, leaf, 2.0 * each / c) for (g, leaf), c in sizes.items()], "grp string, leaf bigint, share double")
        drawn = leaves.join(F.broadcast(chosen), ["grp", "leaf"]).withColumn("draw", F.xxhash64("hash", "leaf"))
        drawn = drawn.where(F.pmod("draw", F.lit(1 << 40)) < F.col("share") * F.lit(float(1 << 40)))
        best = W.partitionBy("grp", "leaf").orderBy("draw")
        drawn = drawn.withColumn("r", F.row_number().over(best)).where(F.col("r") <= each)
        by: dict[tuple, set[bytes]] = {}
        for row in drawn.select("grp", "leaf", "code").collect():
            by.setdefault((row["grp"], row["leaf"]), set()).add(bytes(row["code"]))
        table = leaves.sparkSession.sparkContext.broadcast({key: sorted(codes) for key, codes in by.items() if len(codes) > 1})
        if not table.value:
            return leaves

        only = F.broadcast(chosen.select("grp", "leaf"))

        def work(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grp, leaf, codes = (batch.column(c).to_pylist() for c in ("grp", "leaf", "code"))
                at: dict[tuple, list[int]] = {}
                for n, key in enumerate(zip(grp, leaf)):
                    if key in table.value:
                        at.setdefault(key, []).append(n)
                for key, rows in at.items():
                    nearest = _closeness([codes[n] for n in rows], unpack(table.value[key])).argmax(axis=1)
                    for n, p in zip(rows, nearest.tolist()):
                        leaf[n] = (key[1] * 1_000_003 + p + 1) & 0x3FFF_FFFF_FFFF_FFFF
                columns = [pa.array(leaf, pa.int64()) if c == "leaf" else batch.column(c) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        split = scratch.save(leaves.join(only, ["grp", "leaf"], "left_semi").mapInArrow(work, leaves.schema), "leaves")
        last, leaves = sizes, leaves.join(only, ["grp", "leaf"], "left_anti").unionByName(split)


def _top(edges: DataFrame, k: int, by: tuple[str, ...] = ("u",), to: str = "v", keep: tuple[str, ...] = ()) -> DataFrame:
    """The k closest neighbours of every u, each once; of equal similarity the smaller one. One shuffle, limited before it."""
    order = W.partitionBy(*by).orderBy(F.desc("sim"), to)
    best = edges.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k).drop("r")
    return best.groupBy(*by, to, "sim").agg(*[F.min(c).alias(c) for c in keep]) if keep else best.dropDuplicates([*by, to])


def neighbour_graph(
    coded: DataFrame, scratch: Scratch, k: int = 10, floor: float = 0.7, block: int = 4096, seed: int = 2, delta: float = 0.001, follow: float | None = None, watch=None
) -> DataFrame:
    """Directed edges ``u, v, sim`` (numbers of ``coded``) of the k-nearest-neighbour graph over distinct vectors.

    ``coded`` is a table as from :func:`index`. Exact copies are one node, named by their smallest id. Edges below ``floor`` are not
    kept, those below ``follow`` (as a rule all are above) not followed. The first edges are the ``seed`` closest of every
    vector in each of its leaves; leaves above ``block`` rows are split by further pivots. Each round of NN-descent joins the
    neighbours of a node, as listed by it or listing it, with each other where one of them is new, and scores the pairs not
    known; it ends when at most a share of ``delta`` of the edges changes. ``watch`` is called with every round's graph.
    """
    leaves = coded.select("grp", F.explode(F.col("near").cast("array<bigint>")).alias("leaf"), "n", "id", "hash", "code")
    leaves = _split(leaves, scratch, block)
    first = leaves.repartition("grp", "leaf").sortWithinPartitions("grp", "leaf").mapInArrow(_leaf_edges(seed, floor), "u bigint, v bigint, sim double")
    graph = scratch.save(_top(_both_ways(first), k).withColumn("new", F.lit(True)), "graph")
    total = graph.count()
    while total:
        if watch:
            watch(graph)
        better = _descend(coded, graph, scratch, k, floor, follow)
        if better is None:
            break
        joined = graph.withColumn("new", F.lit(False)).unionByName(_both_ways(better).withColumn("new", F.lit(True)))
        step = scratch.save(_top(joined, k, keep=("new",)), "graph")
        scratch.drop(graph)
        scratch.drop(better)
        graph = step
        sizes = graph.agg(F.count("*").alias("n"), F.count_if("new").alias("new")).first()
        if sizes["new"] <= delta * sizes["n"]:
            break
    if watch:
        watch(graph)
    return graph.select("u", "v", "sim")


def _both_ways(edges: DataFrame) -> DataFrame:
    """Every edge, as seen from either end."""
    ends = F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select(ends, "sim")


def _descend(coded: DataFrame, graph: DataFrame, scratch: Scratch, k: int, floor: float, follow: float | None) -> DataFrame | None:
    """One round of NN-descent: edges ``u, v, sim`` not known before between neighbours of one node, or None if there are none.

    A node's neighbours are the k that it lists and the k closest that list it, so what is joined stays within 2k for any hub. Two
    neighbours that both are old have met before.
    """
    used = graph if follow is None else graph.where(F.col("sim") >= follow)
    back = _top(used.select(F.col("v").alias("m"), F.col("u").alias("w"), "sim", "new"), k, by=("m",), to="w", keep=("new",))
    both = used.select(F.col("u").alias("m"), F.col("v").alias("w"), "new").unionByName(back.select("m", "w", "new"))
    lists = both.groupBy("m").agg(F.collect_set(F.struct("w", "new")).alias("ws")).where(F.exists("ws", lambda x: x["new"]))
    pairs = lists.select("ws", F.explode("ws").alias("x"))
    pairs = pairs.select(F.col("x.w").alias("a"), F.explode(F.filter("ws", lambda y: (y["w"] > F.col("x.w")) & (y["new"] | F.col("x.new")))).alias("y"))
    pairs = pairs.select("a", F.col("y.w").alias("b")).distinct()
    known = graph.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    fresh = scratch.save(pairs.join(known, ["a", "b"], "left_anti"), "fresh")
    count = fresh.count()
    if not count:
        return None
    few = count <= BROADCAST_PAIRS and count <= BROADCAST_SHARE * coded.count()
    scored = score(fresh, coded, few).where(F.col("sim") >= floor)
    better = scratch.save(scored.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim"), "better")
    scratch.drop(fresh)
    return None if better.isEmpty() else better


def score(pairs: DataFrame, coded: DataFrame, small: bool) -> DataFrame:
    """Exact cosine of every pair of numbers ``a, b``. The pairs go to the vectors (broadcast) only where their count is checked."""
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    one = coded.select(F.col("n").alias("a"), F.col("code").alias("code_a")).join(side(pairs), "a")
    two = coded.select(F.col("n").alias("b"), F.col("code").alias("code_b")).join(side(one), "b")
    return two.select("a", "b", "code_a", "code_b").mapInArrow(_cosines, "a bigint, b bigint, sim double")


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, sim`` of rows of two numbers and two codes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ca, cb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        dims = np.array([(len(c) - 1) // (4 if c[0] == 255 else 1) for c in ca])
        sim = np.empty(len(ca))
        for dim in np.unique(dims):
            at = np.nonzero(dims == dim)[0]
            sim[at] = np.einsum("ij,ij->i", unpack([ca[i] for i in at]), unpack([cb[i] for i in at]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(sim, DIGITS))], names=[*batch.schema.names[:2], "sim"])


def named(edges: DataFrame, coded: DataFrame) -> DataFrame:
    """Edges ``grp, u, v, sim`` between ids instead of numbers."""
    ids = lambda n: coded.select(F.col("n").alias(n), F.col("id").alias(f"{n}_id"))
    wide = edges.join(coded.select(F.col("n").alias("u"), "grp", F.col("id").alias("u_id")), "u").join(ids("v"), "v")
    return wide.select("grp", F.col("u_id").alias("u"), F.col("v_id").alias("v"), "sim")


def similar_pairs(rows: DataFrame, min_sim: float = 0.8, k: int = 5, **fit) -> DataFrame:
    """Pairs ``id_a < id_b`` of rows of one group (columns ``grp, id, embedding``) with cosine of at least ``min_sim``, where one is
    among the ``k`` most similar of the other; of equally similar ones (to six digits) the smaller id goes first.

    Rows that repeat an id count once. Copies of one vector are each linked to the k smallest other copies, which are
    their most similar records; copies beyond that are in no list but their own. Vectors that cannot be compared (see
    :func:`encode`) take no part; an empty table gives no pairs. Ids must be unique over the groups.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "knn")
    coded = index(rows, scratch, **fit)
    edges = named(neighbour_graph(coded, scratch, k=2 * k, floor=max(-1.0, min_sim - 0.1)).where(F.col("sim") >= min_sim), coded)

    members = coded.select("grp", "hash", "id").distinct()
    classes = members.groupBy("grp", "hash").agg(F.count("*").alias("n"), F.min("id").alias("node")).where("n > 1")
    copies = scratch.save(members.join(classes.select("grp", "hash", "node"), ["grp", "hash"]).select("grp", "node", "id"), "copies")
    first = copies.withColumn("n", F.row_number().over(W.partitionBy("grp", "node").orderBy("id"))).where(F.col("n") <= k + 1)
    targets = first.groupBy("grp", "node").agg(F.collect_list("id").alias("ids"))

    # Candidates of a node: the first copies of its neighbours and of itself.
    wide = edges.join(targets.select("grp", F.col("node").alias("v"), "ids"), ["grp", "v"], "left")
    wide = wide.select("grp", "u", "sim", F.explode(F.coalesce("ids", F.array("v"))).alias("v"))
    wide = wide.unionByName(first.select("grp", F.col("node").alias("u"), F.lit(1.0).alias("sim"), F.col("id").alias("v")))
    ranked = _top(wide, k + 1, by=("grp", "u"))
    owners = ranked.join(copies.select("grp", F.col("node").alias("u"), F.col("id").alias("own")), ["grp", "u"], "left")
    owners = owners.select("grp", F.coalesce("own", "u").alias("u"), "v", "sim").where("u <> v")
    best = _top(owners, k, by=("grp", "u"))
    return best.select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b")).distinct()


def search(queries: DataFrame, coded: DataFrame, graph: DataFrame, scratch: Scratch, k: int = 10, beam: int = 48, max_entries: int = 8192) -> DataFrame:
    """Greedy search of the graph for every query (``grp, q, code``): ``grp, q, v, sim`` of the k closest nodes.

    A group is entered at as many nodes as it has leaves (the root of its size, 64 at least, ``max_entries`` at most), each query at
    the ``beam`` of them closest to it. All queries at once move to the neighbours of the nodes that are new in their ``beam`` best, by
    a join per step, until no query gets closer. Edges are walked both ways, of those that end in a node the closest ones back, so a
    cluster that no list of others names is reached too. Few queries (:data:`BROADCAST_CODES`) go to the vectors, more are joined.
    """
    nodes = coded.groupBy("grp", "hash").agg(F.min("id").alias("v"), F.min("code").alias("code")).drop("hash")
    nodes = scratch.save(nodes.orderBy("v").withColumn("n", F.monotonically_increasing_id()), "nodes")  # in the order of ids, for ties
    width = graph.groupBy("grp", "u").count().agg(F.max("count")).first()[0] or 1
    back = _top(graph.select("grp", F.col("v").alias("u"), F.col("u").alias("v"), "sim"), width, by=("grp", "u"))
    name = lambda n, v: nodes.select("grp", F.col("n").alias(n), F.col("v").alias(v))
    links = graph.select("grp", "u", "v").unionByName(back.select("grp", "u", "v")).join(name("n", "u"), ["grp", "u"]).join(name("to", "v"), ["grp", "v"])
    links = scratch.save(links.groupBy("n").agg(F.collect_set("to").alias("to")), "links")
    asked = queries.groupBy("grp", "q").agg(F.min("code").alias("code"))
    asked = scratch.save(asked.withColumn("m", F.monotonically_increasing_id()), "queries")
    small = (asked.agg(F.sum(F.length("code"))).first()[0] or 0) <= BROADCAST_CODES
    to = _score_few(asked, nodes) if small else _score_many(asked, nodes)

    def best(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("r", F.row_number().over(W.partitionBy("m").orderBy(F.desc("sim"), "n"))).where(F.col("r") <= n).drop("r")

    found = scratch.save(_enter(asked, nodes, beam, max_entries).withColumn("new", F.lit(True)), "beam")
    while not (front := found.where("new")).isEmpty():
        moves = front.select("m", "n").join(links, "n").select("m", F.explode("to").alias("n"))
        both = to(moves, found, beam).withColumn("new", F.lit(True)).unionByName(found.withColumn("new", F.lit(False)))
        once = both.repartition("m").groupBy("m", "n").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        step = scratch.save(best(once, beam), "beam")
        scratch.drop(found)
        found = step
    out = best(found, k).join(asked.select("m", "grp", "q"), "m").join(nodes.select("n", "v"), "n")
    return out.select("grp", "q", "v", "sim")


def _enter(asked: DataFrame, nodes: DataFrame, beam: int, max_entries: int) -> DataFrame:
    """``m, n, sim``: the ``beam`` entries of its group that are closest to every query. The entries are a sample by hash, broadcast."""
    size = nodes.groupBy("grp").count()
    most = F.least(F.lit(float(max_entries)), F.greatest(F.lit(64.0), F.sqrt("count")))
    part = F.pmod(F.xxhash64("v", F.lit(17)), F.lit(1 << 40)) < most / F.col("count") * F.lit(float(1 << 40))
    by: dict[str, list] = {}
    for row in nodes.join(size, "grp").where(part).select("grp", "n", "code").orderBy("n").collect():
        by.setdefault(row["grp"], []).append((row["n"], bytes(row["code"])))
    table = asked.sparkSession.sparkContext.broadcast({g: (np.array([n for n, _ in r]), [c for _, c in r]) for g, r in by.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[str, np.ndarray] = {}
        for batch in batches:
            at: dict[str, list[tuple[int, bytes]]] = {}
            for g, m, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                at.setdefault(g, []).append((m, c))
            for g, rows in at.items():
                if g not in table.value:
                    continue
                ns, codes = table.value[g]
                if g not in entries:
                    entries[g] = unpack(codes)
                for s in range(0, len(rows), 1024):
                    ms = np.array([m for m, _ in rows[s : s + 1024]])
                    vectors = unpack([c for _, c in rows[s : s + 1024]])
                    close = vectors @ entries[g].T
                    top = np.argpartition(-close, min(beam, len(ns)) - 1, axis=1)[:, :beam]
                    a, b = np.repeat(np.arange(len(ms)), top.shape[1]), top.ravel()
                    sim = np.einsum("ij,ij->i", vectors[a], entries[g][b])
                    yield pa.RecordBatch.from_arrays([pa.array(ms[a]), pa.array(ns[b]), pa.array(np.round(sim, DIGITS))], names=["m", "n", "sim"])

    return spread(asked.select("grp", "m", "code")).mapInArrow(work, "m bigint, n bigint, sim double")


def _score_few(asked: DataFrame, nodes: DataFrame):
    """Scores pairs ``m, n``: every node's vector meets the broadcast ones of its queries, so it moves once. What no full beam can take is left out."""
    rows = sorted((r["m"], bytes(r["code"])) for r in asked.select("m", "code").collect())
    by: dict[int, list] = {}
    for m, c in rows:
        by.setdefault((len(c) - 1) // (4 if c[0] == 255 else 1), []).append((m, c))
    table = asked.sparkSession.sparkContext.broadcast({dim: (np.array([m for m, _ in r]), [c for _, c in r]) for dim, r in by.items()})

    def to(pairs: DataFrame, found: DataFrame, beam: int) -> DataFrame:
        full = found.groupBy("m").agg(F.count("*").alias("c"), F.min("sim").alias("least")).where(F.col("c") >= beam)
        least = asked.sparkSession.sparkContext.broadcast({r["m"]: r["least"] for r in full.collect()})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[int, tuple] = {}
            for batch in batches:
                out: list[list] = [[], [], []]
                for n, ms, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    dim = (len(c) - 1) // (4 if c[0] == 255 else 1)
                    if dim not in ready:
                        ids, codes = table.value[dim]
                        ready[dim] = ids, unpack(codes), np.array([least.value.get(m, -2.0) for m in ids.tolist()])
                    ids, vectors, floor = ready[dim]
                    at = np.searchsorted(ids, ms.values.to_numpy())
                    sim = np.round(np.einsum("ij,j->i", vectors[at], unpack([c])[0]), DIGITS)
                    keep = sim >= floor[at]
                    out[0].append(ids[at[keep]])
                    out[1].append(np.full(int(keep.sum()), n))
                    out[2].append(sim[keep])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["m", "n", "sim"])

        wide = pairs.groupBy("n").agg(F.collect_set("m").alias("ms")).join(nodes.select("n", "code"), "n")
        return wide.select("n", "ms", "code").mapInArrow(work, "m bigint, n bigint, sim double")

    return to


def _score_many(asked: DataFrame, nodes: DataFrame):
    """As :func:`_score_few`, with the vectors of both sides joined to the pairs."""

    def to(pairs: DataFrame, found: DataFrame, beam: int) -> DataFrame:
        fresh = pairs.distinct().join(found.select("m", "n"), ["m", "n"], "left_anti")
        wide = fresh.join(asked.select("m", F.col("code").alias("code_q")), "m").join(nodes.select("n", "code"), "n")
        return wide.select("m", "n", "code_q", "code").mapInArrow(_cosines, "m bigint, n bigint, sim double")

    return to


def closest_rows(found: DataFrame, coded: DataFrame, k: int) -> DataFrame:
    """``grp, q, v, sim``: the k closest other rows of every query, from its k + 1 closest nodes. Every copy of a node's vector is a row."""
    members = coded.select("grp", "hash", "id").distinct()
    first = members.withColumn("n", F.row_number().over(W.partitionBy("grp", "hash").orderBy("id"))).where(F.col("n") <= k + 1)
    node = members.groupBy("grp", "hash").agg(F.min("id").alias("node"))
    rows = found.join(first.join(node, ["grp", "hash"]).select("grp", F.col("node").alias("v"), "id"), ["grp", "v"]).where("id <> q")
    return _top(rows.select("grp", F.col("q").alias("u"), F.col("id").alias("v"), "sim"), k, by=("grp", "u")).withColumnRenamed("u", "q")
