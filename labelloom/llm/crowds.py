"""Links among nodes that meet on keys, without comparing all pairs of a crowd.

Where at most FEW nodes meet on a key, their pairs are compared. In a crowd, all are compared with the most central node
and one other; that joins most of a crowd of near copies to one component. What is left outside the largest component
of a crowd is compared with all of it, in tiles of bounded size that are spread over tasks; within a tile, two
components that one link has joined are not compared again. Nothing is dropped or capped: no link between two
components is lost, and what leaves a tile is links alone.

That is meeting_roots, for classes. linked_nodes finds every link, those within a class too: all pairs of a crowd are
compared in such tiles, and what leaves a tile is each node's number of links and the links that join its classes.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import bounded_batches, checkpoint

FEW = 32
#: Rows, and bytes, of a side of a tile.
TILE = 256
TILE_BYTES = 16_000_000

Step = Callable[[DataFrame], DataFrame]
#: Two lists of data -> the places (i, j) that may be linked, and whether a place is.
Compare = Callable[[list[bytes], list[bytes]], tuple["zip", Callable[[int, int], bool]]]


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node of links (a, b), the smallest node that it reaches.

    Alternates large and small stars: each node's larger neighbours, then its smaller ones and itself, are linked to
    the smallest. A round is a few aggregations and joins of links; the number of rounds grows with the logarithm of
    the longest chain. Rounds end when no link changes, told by a sum over all links.
    """
    links = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def total(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = total(links)
    while last[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        links = checkpoint(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = total(links)
        if now == last:
            break
        last = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with their root; a node without links is its own."""
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def pairs_of(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, that share a key; on reads both sides as l and r."""
    met = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & on)
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def tile_links(members: DataFrame, data: DataFrame, make: Callable[[], Compare]) -> DataFrame:
    """Links (a, b) between nodes of a group, of which one is outside the group's largest component. members: key (the
    group), node, root, outside. data: node, data."""

    def compare(table: pa.Table) -> pa.Table:
        rows = table.select(["node", "root", "outside", "data", "left"]).to_pylist()
        xs, ys = [r for r in rows if r["left"]], [r for r in rows if not r["left"]]
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                x = up
            return x

        found = []
        places, linked = make()([r["data"] for r in xs], [r["data"] for r in ys])
        for i, j in places:
            if ys[j]["outside"] and xs[i]["node"] >= ys[j]["node"]:
                continue  # they meet the other way round as well
            a, b = root(xs[i]["root"]), root(ys[j]["root"])
            if a != b and linked(i, j):
                joined[max(a, b)] = min(a, b)
                found.append((xs[i]["node"], ys[j]["node"]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    bounded_batches(members.sparkSession)
    rows = members.join(data, "node")
    tiles = lambda n, size: F.ceil(F.greatest(n / TILE, size / TILE_BYTES)).cast("int")
    n, size = F.count("*"), F.sum(F.octet_length("data"))
    of = rows.groupBy("key").agg(tiles(F.count_if("outside"), F.coalesce(F.sum(F.when(F.col("outside"), F.octet_length("data"))), F.lit(0))).alias("lefts"), tiles(n, size).alias("rights"))
    # Merged, so that a large group's rows can be split over tasks, and dealt anew before they are multiplied.
    placed = rows.join(of.hint("merge"), "key").repartition("key", "node").withColumn("mark", F.xxhash64("key", "node"))
    side = lambda own, others, left: F.transform(F.sequence(F.lit(0), F.col(others) - 1), lambda k: F.struct((F.pmod("mark", own).cast("int") if left else k).alias("i"), (k if left else F.pmod("mark", own).cast("int")).alias("j"), F.lit(left).alias("left")))
    both = F.concat(F.when(F.col("outside"), side("lefts", "rights", True)).otherwise(F.array()), side("rights", "lefts", False))
    spread = placed.select("key", "node", "root", "outside", "data", F.explode(both).alias("x")).select("key", "x.i", "x.j", "x.left", "node", "root", "outside", "data")
    return spread.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def meeting_roots(met: DataFrame, verify: Step, may: Column, centre: Step, data: DataFrame, make: Callable[[], Compare], more: DataFrame, few: int = FEW) -> DataFrame:
    """node, root of the linked nodes. met: key, node, n (rows of the key), low (the key's smallest node) and what may
    reads of both sides, l and r. verify: pairs (a, b) -> those that are linked. centre: crowds' members -> the same
    with a column centre, larger for nodes that are likely to reach more; members that reach none may be left out.
    data: node, data (of all nodes that meet); make: as of tile_links. more: pairs (a, b) that meet otherwise."""
    few_met = met.where(F.col("n") <= few)
    links = checkpoint(verify(checkpoint(pairs_of(few_met, few_met, (F.col("l.node") < F.col("r.node")) & may).unionByName(more).distinct())))
    crowds = met.where(F.col("n") > few).select("key", "node", "low")
    if crowds.isEmpty():
        return checkpoint(components(links))
    crowds = checkpoint(centre(crowds))
    # Written out, so that the join isn't one stage with the aggregation and a large crowd's rows can be split over tasks.
    most = checkpoint(crowds.groupBy("key").agg(F.max(F.struct("centre", "node")).alias("x")).select("key", F.col("x.node").alias("most")))
    star = lambda name: F.struct(F.least("node", name).alias("a"), F.greatest("node", name).alias("b"))
    stars = crowds.join(most.hint("merge"), "key").select(F.explode(F.array(star("most"), star("low"))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
    links = checkpoint(links.unionByName(verify(checkpoint(stars))))
    roots = checkpoint(components(links))
    known = checkpoint(named(crowds.select("key", "node"), roots))
    sizes = known.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("giant"), F.sum("c").alias("n"))
    left = known.join(sizes.where("n > giant.c").select("key", F.col("giant.root").alias("giant")), "key")
    # Crowds of one largest component are one group: what meets on many of their keys is compared once.
    groups = checkpoint(left.select(F.col("giant").alias("key"), "node", "root", (F.col("root") != F.col("giant")).alias("outside")).distinct())
    if groups.isEmpty():
        return roots
    return checkpoint(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(tile_links(groups, data, make))))


def tile_counts(held: DataFrame, data: DataFrame, make: Callable[[], Compare]) -> DataFrame:
    """Of all links between nodes that share a key: rows (a, null, n), n of the links of node a, to be summed, and links
    (a, b, 0) that join the same components. held: node, keys (sorted). A pair counts on the first key that both have."""

    def compare(table: pa.Table) -> pa.Table:
        key, diagonal = table["key"][0].as_py(), table["i"][0] == table["j"][0]
        rows = sorted(table.select(["node", "keys", "data", "left"]).to_pylist(), key=lambda r: r["node"])
        xs = [r for r in rows if r["left"]]
        ys = xs if diagonal else [r for r in rows if not r["left"]]
        sets = {r["node"]: frozenset(r["keys"]) for r in rows}
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                joined[x] = x = joined.get(up, up)
            return x

        n: dict[int, int] = {}
        found = []
        places, linked = make()([r["data"] for r in xs], [r["data"] for r in ys])
        for i, j in places:
            a, b = xs[i]["node"], ys[j]["node"]
            if diagonal and i >= j or min(sets[a] & sets[b]) != key or not linked(i, j):
                continue
            n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
            if (u := root(a)) != (v := root(b)):
                joined[max(u, v)] = min(u, v)
                found.append((a, b))
        ends = [[*n, *(x for x, _ in found)], [*[None] * len(n), *(y for _, y in found)], [*n.values(), *[0] * len(found)]]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip("abn", ends)})

    bounded_batches(held.sparkSession)
    rows = held.join(data, "node").select(F.explode("keys").alias("key"), "node", "keys", "data")
    of = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.octet_length("data")) / TILE_BYTES)).cast("int").alias("tiles"))
    # Merged, so that a large crowd's rows can be split over tasks, and dealt anew before they are multiplied.
    placed = rows.join(of.hint("merge"), "key").repartition("key", "node").withColumn("own", F.pmod(F.xxhash64("key", "node"), "tiles").cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") <= k).alias("left")))
    spread = placed.select("key", "node", "keys", "data", F.explode(tiles).alias("x")).select("key", "x.i", "x.j", "x.left", "node", "keys", "data")
    return spread.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, n long")


def linked_nodes(met: DataFrame, verify: Step, may: Column, data: DataFrame, make: Callable[[], Compare], few: int | None = None) -> DataFrame:
    """node, root, n_links of the nodes that have a link: the smallest node that it reaches, and how many other nodes it is
    linked to itself. met, verify, may, data, make: as of meeting_roots, without low; few: FEW."""
    few = FEW if few is None else few
    few_met = met.where(F.col("n") <= few)
    links = checkpoint(verify(checkpoint(pairs_of(few_met, few_met, (F.col("l.node") < F.col("r.node")) & may))))
    crowds = met.where(F.col("n") > few).select("key", "node")
    ends = lambda x: x.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
    if crowds.isEmpty():
        each, joins = ends(links), links
    else:
        held = checkpoint(crowds.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys")))
        tiles = checkpoint(tile_counts(held, data, make))
        apart = links
        for side in ("a", "b"):
            apart = apart.join(held.select(F.col("node").alias(side), F.col("keys").alias(f"keys_{side}")), side, "left")
        # What meets in a crowd as well is counted there.
        apart = apart.where(~F.coalesce(F.arrays_overlap("keys_a", "keys_b"), F.lit(False)))
        each = ends(apart).unionByName(tiles.where("b is null").select(F.col("a").alias("node"), "n"))
        joins = links.unionByName(tiles.where("b is not null").select("a", "b"))
    roots = components(joins)
    return named(each.groupBy("node").agg(F.sum("n").alias("n_links")), roots).select("node", "root", "n_links")
