"""Parent-child rows to full hierarchies by tree contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch


def part_edges(rel: DataFrame) -> DataFrame:
    """Clean (child, parent) pairs of ``src, dst, kind`` rows.

    Ids lose blanks and case. A kind is read by its letters alone, so ``Part_Of ``, ``part of`` and ``partOf`` are one:
    ``partof`` makes src the child, ``haspart`` makes dst the child, all else (``related``, null) does not count. Rows with a
    null or empty id and rows from a node to itself do not count either. A node given several parents keeps the
    smallest one, so that the result stays a forest.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    kind = F.regexp_replace(F.lower("kind"), r"[^a-z]", "")
    rows = rel.select(clean("src").alias("s"), clean("dst").alias("d"), kind.alias("k")).where(
        F.col("k").isin("partof", "haspart") & (F.col("s") != F.col("d")) & (F.col("s") != "") & (F.col("d") != "")
    )
    up = F.col("k") == "partof"
    return (
        rows.select(F.when(up, F.col("s")).otherwise(F.col("d")).alias("id"), F.when(up, F.col("d")).otherwise(F.col("s")).alias("parent"))
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )


def hierarchy(edges: DataFrame, together: int = 4, max_rounds: int = 400) -> DataFrame:
    """Root, depth, path and number of nodes below of every node of ``edges`` (``id, parent``, one row per id).

    Result: ``node_id, root_id, depth, path, n_below``. On a loop: ``root_id`` the smallest id of the loop, depth -1, path
    ''; below a loop: the same root_id, depth -2, path ''; ``n_below`` never counts the node itself. An empty table gives
    an empty result.

    Method: each round rakes all leaves into their parents and compresses unary chains (a node with one child that is no
    leaf is spliced out where its round hash exceeds those of its parent and child, so no two neighbours go at once). An
    edge carries the length, the ids and the weight of what was spliced out of it. Both shrink a tree of n nodes in about
    log n rounds whatever its depth. A loop shrinks to one node whose parent is itself: the core that does not end. Every
    node that goes leaves a record: the node that was its parent then and, if spliced, its child then. The contraction is
    undone by following these records: records that point at records are composed pair by pair, so log of the number of
    rounds joins resolve all nodes. A round is two aggregations by node, without a join, and ``together`` rounds are one
    plan; what it writes into the shared folder cuts the lineage. A node with a third of all children receives sums that
    each task has made before the shuffle. Only row counts reach the driver.
    """
    return _named(_expanded(*_contracted(edges, together, max_rounds)))


def descendants(edges: DataFrame, together: int = 4) -> DataFrame:
    """``node_id, below_id, distance``: every node of ``edges`` (``id, parent``) with every node below it, as rows.

    In a tree the rows follow from the paths. A node on a loop has no node below or above that is told apart by distance: of a
    loop and what hangs below it there are the rows of the hanging nodes among themselves, and the loop is named by ``root_id`` of
    :func:`hierarchy`. A leaf gives no row; an empty table gives none.
    """
    nodes = _expanded(*_contracted(edges, together, 400))
    up = nodes.where("status <> 'loop'").select("id", F.split("path", ">").alias("p"))
    above = up.select("id", F.size("p").alias("n"), F.posexplode("p").alias("at", "node_id")).where(F.col("at") < F.col("n") - 1)
    # The path of a node below a loop begins with nodes of the loop.
    loops = nodes.where("status = 'loop'").select(F.col("id").alias("node_id"))
    return above.join(loops, "node_id", "left_anti").select("node_id", F.col("id").alias("below_id"), (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))


_LIVE = "struct<id:string,parent:string,leaf:boolean,len:bigint,hid:bigint,acc:bigint,seg:string,turn:int>"
_GONE = "struct<tag:string,parent:string,child:string,len:bigint,seg:string,weight:bigint>"
_NONE = {"own": _LIVE, "gone": _GONE, "gain": "bigint", "kid": "struct<id:string,hid:bigint>", "up": "struct<id:string,len:bigint,hid:bigint,seg:string>"}


def _row(key, **given):
    """A row for ``key`` that states some of: the node itself, its record, a raked child's weight, a child, a new edge upwards."""
    return F.struct(key.alias("key"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _NONE.items()])


def _contracted(edges: DataFrame, together: int, max_rounds: int) -> tuple[Scratch, list[DataFrame]]:
    """The tables of records ``key, gone`` of all rounds."""
    scratch = Scratch(edges.sparkSession, "hierarchy")
    ends = F.array(F.struct("id", "parent"), F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")))
    both = edges.select(F.col("id").cast("string"), F.col("parent").cast("string")).select(F.inline(ends))
    zero = F.lit(0).cast("bigint")
    live = both.groupBy("id").agg(F.max("parent").alias("parent")).select(
        F.col("id").alias("key"),
        F.struct("id", "parent", F.lit(False).alias("leaf"), F.lit(1).cast("bigint").alias("len"), zero.alias("hid"), zero.alias("acc"), F.lit("").alias("seg"), F.lit(0).alias("turn")).cast(_LIVE).alias("own"),
        F.lit(None).cast(_GONE).alias("gone"),
    )
    records: list[DataFrame] = []
    steps = [_rake(), _splice(), _move()]  # the expressions of a round are made once
    for _ in range(0, max_rounds, together):
        for _ in range(together):
            for columns, heard in steps[:2]:
                live = live.select(*columns).groupBy("key").agg(*heard)
            live = live.select(*steps[2])
        out = scratch.save(live, "rounds")
        records.append(out)
        live = out.where("own IS NOT NULL")
        if live.isEmpty():
            return scratch, records
    raise RuntimeError(f"the contraction did not end within {max_rounds} rounds")


def _rake() -> tuple[list[Column], list[Column]]:
    """Leaves become records and their parents gain their weight; every node hears of its other children: what is said, and what is made of it by node."""
    own = F.col("own")
    weight = own["acc"] + own["hid"] + 1
    record = F.struct(F.lit("raked").alias("tag"), own["parent"].alias("parent"), F.lit(None).cast("string").alias("child"), own["len"].alias("len"), own["seg"].alias("seg"), own["acc"].alias("weight"))
    said = (
        F.when(own.isNull(), F.array(_row(F.col("key"), gone=F.col("gone"))))
        .when(own["leaf"], F.array(_row(own["id"], gone=record), _row(own["parent"], gain=weight)))
        .when(own["parent"].isNull(), F.array(_row(own["id"], own=own)))
        .otherwise(F.array(_row(own["id"], own=own), _row(own["parent"], kid=F.struct(own["id"].alias("id"), own["hid"].alias("hid")))))
    )
    return [F.inline(said)], [F.max("own").alias("own"), F.max("gone").alias("gone"), F.sum("gain").alias("gain"), F.count("kid").alias("n"), F.min("kid").alias("only")]


def _splice() -> tuple[list[Column], list[Column]]:
    """Every second or third node of a chain becomes a record and its child takes over its edge; roots and cores end."""
    own, only, n = F.col("own"), F.col("only"), F.col("n")
    acc = own["acc"] + F.coalesce("gain", F.lit(0))
    order = lambda c: F.xxhash64(c, own["turn"])
    fresh = lambda leaf: F.struct(
        own["id"].alias("id"), own["parent"].alias("parent"), leaf.alias("leaf"), own["len"].alias("len"), own["hid"].alias("hid"), acc.alias("acc"), own["seg"].alias("seg"), (own["turn"] + 1).alias("turn")
    )
    record = lambda tag, weight, child=None: F.struct(
        F.lit(tag).alias("tag"), (own["parent"] if child is not None else F.lit(None)).cast("string").alias("parent"), (only["id"] if child is not None else F.lit(None)).cast("string").alias("child"),
        own["len"].alias("len"), own["seg"].alias("seg"), weight.alias("weight"),
    )
    chain = (n == 1) & own["parent"].isNotNull() & (own["parent"] != own["id"])
    goes = chain & (order(own["id"]) > order(own["parent"])) & (order(own["id"]) > order(only["id"]))
    core = (n == 1) & (own["parent"] == own["id"]) & (only["id"] == own["id"])
    said = (
        F.when(own.isNull(), F.array(_row(F.col("key"), gone=F.col("gone"))))
        .when((n == 0) & own["parent"].isNull(), F.array(_row(own["id"], gone=record("root", acc))))
        .when(core, F.array(_row(own["id"], gone=record("core", acc + own["hid"]))))
        .when(goes, F.array(
            _row(own["id"], gone=record("spliced", acc + only["hid"] + 1, True)),
            _row(only["id"], up=F.struct(own["parent"].alias("id"), own["len"].alias("len"), (own["hid"] + acc + 1).alias("hid"), F.concat(own["seg"], F.lit(">"), own["id"]).alias("seg"))),
        ))
        .otherwise(F.array(_row(own["id"], own=fresh(n == 0))))
    )
    return [F.inline(said)], [F.max("own").alias("own"), F.max("gone").alias("gone"), F.max("up").alias("up")]


def _move() -> list[Column]:
    """The node with the edge that it took over, if any."""
    own, up = F.col("own"), F.col("up")
    moved = F.struct(
        own["id"].alias("id"), up["id"].alias("parent"), own["leaf"].alias("leaf"), (own["len"] + up["len"]).alias("len"), (own["hid"] + up["hid"]).alias("hid"), own["acc"].alias("acc"),
        F.concat(up["seg"], own["seg"]).alias("seg"), own["turn"].alias("turn"),
    )
    return [F.col("key"), F.when(own.isNotNull() & up.isNotNull(), moved).otherwise(own).cast(_LIVE).alias("own"), F.col("gone")]


def _expanded(scratch: Scratch, records: list[DataFrame]) -> DataFrame:
    """``id, root, status, depth, path, below`` of every node, by composing the records until none points at another."""
    gone = F.col("gone")
    rows = scratch.together(records).where("gone IS NOT NULL").select(
        F.col("key").alias("id"), gone["parent"].alias("up"), gone["child"].alias("down"), F.when(gone["parent"].isNull(), 0).otherwise(gone["len"]).cast("bigint").alias("depth"),
        F.when(gone["parent"].isNull(), F.col("key")).otherwise(F.concat(gone["seg"], F.lit(">"), F.col("key"))).alias("path"), gone["weight"].alias("below"),
        F.when(gone["parent"].isNull(), F.col("key")).alias("root"), F.when(gone["parent"].isNull(), gone["tag"] == "core").alias("core"), F.coalesce(gone["tag"] == "core", F.lit(False)).alias("loop"),
    )
    rows = scratch.save(rows, "resolved")
    for table in records:
        scratch.drop(table)
    while not rows.where("up IS NOT NULL OR down IS NOT NULL").isEmpty():
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"), F.col("path").alias("a_path"), F.col("root").alias("a_root"), F.col("core").alias("a_core"))
        under = rows.select(F.col("id").alias("down"), F.col("down").alias("u_down"), F.col("below").alias("u_below"), F.col("loop").alias("u_loop"))
        wide = rows.join(above, "up", "left").join(under, "down", "left")
        has = F.col("up").isNotNull()
        before = rows
        rows = scratch.save(
            wide.select(
                "id", F.col("a_up").alias("up"), F.col("u_down").alias("down"), F.when(has, F.col("a_depth") + F.col("depth")).otherwise(F.col("depth")).alias("depth"),
                F.when(has, F.concat("a_path", "path")).otherwise(F.col("path")).alias("path"),
                # The nodes of a loop all have the others of it, and what hangs there, below them.
                F.when(F.col("down").isNull(), F.col("below")).when(F.col("u_loop"), F.col("u_below")).otherwise(F.col("below") + F.col("u_below")).alias("below"),
                F.when(has, F.col("a_root")).otherwise(F.col("root")).alias("root"), F.when(has, F.col("a_core")).otherwise(F.col("core")).alias("core"),
                F.when(F.col("down").isNull(), F.col("loop")).otherwise(F.col("u_loop")).alias("loop"),
            ),
            "resolved",
        )
        scratch.drop(before)
    status = F.when(F.col("loop"), "loop").when(F.col("core"), "below").otherwise("tree")
    return rows.select("id", "root", status.alias("status"), F.col("depth").cast("int").alias("depth"), "path", F.col("below").cast("int").alias("below"))


def _named(nodes: DataFrame) -> DataFrame:
    """The result with every loop named by its smallest id."""
    loops = nodes.where("status = 'loop'").groupBy(F.col("root").alias("loop")).agg(F.min("id").alias("first"))
    named = nodes.join(loops, (F.col("root") == F.col("loop")) & (F.col("status") != "tree"), "left")
    tree = F.col("status") == "tree"
    return named.select(
        F.col("id").alias("node_id"),
        F.coalesce("first", "root").alias("root_id"),
        F.when(tree, F.col("depth")).when(F.col("status") == "loop", F.lit(-1)).otherwise(F.lit(-2)).cast("int").alias("depth"),
        F.when(tree, F.col("path")).otherwise(F.lit("")).alias("path"),
        F.col("below").alias("n_below"),
    )
