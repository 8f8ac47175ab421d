"""Graph operators over an edge table.

Edges have src, dst (NULL where nothing was decided), kind, state, ev_class, target_name,
source_path and start_byte. Ids are strings whose order is the order of identities. Levels of
a walk are joins of a frontier with the edges; only counts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V
from tessera.runtime import checkpoint

#: A frontier of at most so many nodes is broadcast; a larger one is joined by a shuffle.
BROADCAST_NODES = 100_000
#: A frontier of at most so many nodes goes into the plan as literals, which reach the scan.
LITERAL_NODES = 500


def touches(edges: DataFrame, near: str, *nodes: str) -> F.Column:
    """Edges whose end ``near`` (src or dst) is among ``nodes``. Where the edges have the columns
    that ids are made of, those are asked too: unlike ids they are stored, so that the filter
    reaches the scan and, as files are ranges of paths, skips most of them."""
    same = F.col(near) == nodes[0] if len(nodes) == 1 else F.col(near).isin(*nodes)
    column = {"src": "source_path", "dst": "target_path"}[near]
    name = {"src": "source_qualified_name", "dst": "target_qualified_name"}[near]
    parts = [n.split(X.ID_MARK) for n in nodes]
    if {column, name} <= set(edges.columns) and all(len(p) == 4 for p in parts):
        some = lambda c, values: F.col(c) == values[0] if len(values) == 1 else F.col(c).isin(*values)
        same = some(column, sorted({p[0] for p in parts})) & some(name, sorted({p[2] for p in parts})) & same
    return same


def followable(edges: DataFrame, follow_inferred: bool = True) -> DataFrame:
    return edges.where(X.walk_followable("kind", "state", "dst", follow_inferred))


def one_hop(edges: DataFrame, node: str, direction: str = "out", kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Proven callees (out) or callers (in) of a node: (id), ordered."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    rows = edges.where(touches(edges, near, node) & X.is_followable("state", "dst"))
    rows = rows.where(F.col("kind") == kind) if kind else rows
    out = rows.select(F.col(far).alias("id")).distinct().orderBy("id")
    return out.limit(limit) if limit else out


def adjacency(edges: DataFrame, node: str, direction: str = "out", kind: str | None = None, limit: int | None = None) -> DataFrame:
    """All edges of a node in the order of its index; the limit is a top-k, not a sort of all."""
    near, second = ("src", "target_name") if direction == "out" else ("dst", "source_path")
    rows = edges.where(touches(edges, near, node))
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.orderBy("kind", second, "start_byte", "src", "dst")
    return rows.limit(limit) if limit else rows


@dataclass
class Walk:
    steps: DataFrame
    inspected: int = 0
    visited: int = 0
    closed: int = 0
    revisits: int = 0
    followed_inferred: int = 0
    bounded: bool = False
    by_level: list[int] = field(default_factory=list)

    @property
    def max_distance(self) -> int:
        return len(self.by_level)

    def at_distance(self, d: int) -> DataFrame:
        return self.steps.where(F.col("distance") == d)

    def summary(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.inspected, self.visited, self.closed, self.revisits, self.followed_inferred, self.bounded, self.max_distance)],
            "inspected long, visited long, closed long, revisits long, followed_inferred long, bounded boolean, max_distance int")


def walk(edges: DataFrame, target: str, depth: int, direction: str = "in", kind: str | None = None, follow_inferred: bool = True,
         members: DataFrame | None = None, max_edges: int | None = V.RELATIONS_PER_ENTITY, max_visited: int | None = V.MAX_VISITED) -> Walk:
    """Breadth-first walk: shortest distance and first discovery of every node reached.

    ``members`` (id, state) of a container are steps at distance 1 whatever the depth, and a
    node is expanded while its distance is under ``depth``. Structural edges are read but never
    followed. ``max_edges`` per node and ``max_visited`` expanded nodes bound the walk and set
    ``bounded``; None lifts them.
    """
    spark = edges.sparkSession
    near, far, second = ("dst", "src", "source_path") if direction == "in" else ("src", "dst", "target_name")
    pool = edges.where(F.col("kind") == kind) if kind else edges
    order = ["kind", second, "start_byte", "src", "dst"]
    out = Walk(None)
    columns = "id string, distance int, via string, via_kind string, via_state string"
    steps = spark.createDataFrame([], columns)
    known = spark.createDataFrame([(target,)], "id string")
    seeds = None
    if members is not None:
        seeds = checkpoint(members.where(F.col("id") != target).groupBy("id").agg(F.min("state").alias("state")))
        n = seeds.count()
        if n:
            steps = steps.unionByName(seeds.select("id", F.lit(1).alias("distance"), F.lit(target).alias("via"), F.lit("contains").alias("via_kind"), F.col("state").alias("via_state")))
            known = known.unionByName(seeds.select("id"))
            out.by_level.append(n)
    for d in range(depth):
        frontier = spark.createDataFrame([(target,)], "id string") if d == 0 else steps.where(F.col("distance") == d).select("id")
        if max_visited is not None:
            room = max_visited - out.visited
            frontier = checkpoint(frontier.orderBy("id").limit(room + 1))
            size = frontier.count()
            if size > room:
                out.bounded = True
                frontier, size = frontier.orderBy("id").limit(room), room
        else:
            size = frontier.count()
        if not size:
            break
        out.visited += size
        if d == 0:  # a literal reaches the scan, below any aggregation that makes the edges
            hits = pool.where(touches(pool, near, target)).withColumn("_node", F.lit(target))
        elif size <= LITERAL_NODES:
            hits = pool.where(touches(pool, near, *[r["id"] for r in frontier.collect()])).withColumn("_node", F.col(near))
        else:
            side = frontier.withColumnRenamed("id", "_node")
            hits = pool.join(F.broadcast(side) if size <= BROADCAST_NODES else side, F.col(near) == F.col("_node"))
        if max_edges is not None:
            w = Window.partitionBy("_node").orderBy(*order)
            hits = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_edges)
        hits = checkpoint(hits)
        good = followable(hits, follow_inferred).withColumn("_other", F.col(far))
        counts = hits.agg(F.count("*").alias("n"), *([F.max("_rn").alias("m")] if max_edges is not None else [])).first()
        reached = good.agg(F.count("*").alias("f"), F.count(F.when(F.col("_other") == target, 1)).alias("t")).first()
        # the first discovery: smallest parent, then the order of its edges
        first = good.where(F.col("_other") != target).groupBy(F.col("_other").alias("id")).agg(F.min(F.struct("_node", *order, "state")).alias("v"))
        new = checkpoint(first.join(known, "id", "left_anti").select("id", F.lit(d + 1).alias("distance"), F.col("v._node").alias("via"), F.col("v.kind").alias("via_kind"), F.col("v.state").alias("via_state")))
        fresh = new.agg(F.count("*").alias("n"), F.count(F.when(F.col("via_state") == "inferred", 1)).alias("i")).first()
        out.inspected += counts["n"]
        if max_edges is not None and (counts["m"] or 0) >= max_edges:
            out.bounded = True
        out.closed += reached["f"] - fresh["n"]
        out.revisits += reached["f"] - fresh["n"] - reached["t"]
        out.followed_inferred += fresh["i"]
        if fresh["n"]:
            if len(out.by_level) <= d:
                out.by_level.append(fresh["n"])
            else:
                out.by_level[d] += fresh["n"]
            steps = steps.unionByName(new)
            known = known.unionByName(new.select("id"))
        elif not (d == 0 and seeds is not None):
            break
        if out.bounded and max_visited is not None and out.visited >= max_visited:
            break
    out.steps = steps
    return out


def dependents(edges: DataFrame, target: str, depth: int, **options) -> Walk:
    return walk(edges, target, depth, "in", **options)


def callers(edges: DataFrame, target: str, **options) -> Walk:
    return walk(edges, target, 1, "in", **options)


def callees(edges: DataFrame, target: str, **options) -> Walk:
    return walk(edges, target, 1, "out", **options)


def membership(edges: DataFrame, entities: DataFrame, container: str, container_path: str | None = None) -> DataFrame:
    """(id, state): stored structural edges out of a container, and for a file the entities of
    its path that none of them reaches, which are inferred members."""
    stored = edges.where(touches(edges, "src", container) & X.is_structural("kind") & X.is_followable("state", "dst")).groupBy(F.col("dst").alias("id")).agg(F.max("state").alias("state"))
    if container_path is None:
        return stored
    own = entities.where((F.col("path") == container_path) & (F.col("id") != container)).select("id").join(stored, "id", "left_anti")
    return stored.unionByName(own.select("id", F.lit("inferred").alias("state")))


def explain(edges: DataFrame, node: str, limit: int | None = V.RELATIONS_PER_ENTITY) -> DataFrame:
    """Incoming and outgoing edges of a node with their side, neighbour and strength."""
    sides = []
    for side, name in ((0, "in"), (1, "out")):
        rows = adjacency(edges, node, name, None, limit)
        sides.append(rows.withColumn("side", F.lit(name)).withColumn("neighbour", F.col("src") if name == "in" else F.coalesce("dst", "target_name")))
    both = sides[0].unionByName(sides[1])
    return both.withColumn("strength", F.when(X.is_followable("state", "dst"), X.strength("ev_class")).otherwise(0)).orderBy("side", "kind", "source_path", "src", "target_name", "start_byte")


def explain_relation(edges: DataFrame, src: str, kind: str, target_name: str, start_byte: int, limit: int | None = V.RELATIONS_PER_ENTITY) -> DataFrame:
    """What else touches the source of an edge: as ``explain`` without the edge itself."""
    itself = (F.col("src") == src) & (F.col("kind") == kind) & (F.col("target_name") == target_name) & (F.col("start_byte") == start_byte)
    return explain(edges, src, limit).where(~itself)


def uncertain(explained: DataFrame) -> DataFrame:
    return explained.where(F.col("state").isin("ambiguous", "unresolved"))


def strongest_incoming(edges: DataFrame, follow_inferred: bool = True) -> DataFrame:
    """The edge that best explains each node, and how many could: (id, via, kind, strength,
    alternatives). One aggregation, with ties by natural key."""
    rows = edges.where(X.chainable("state", "dst", follow_inferred)).withColumn("_w", X.strength("ev_class"))
    best = rows.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("_w")).alias("w"), "kind", "source_path", "src", "target_name", "start_byte")).alias("b"), F.count("*").alias("alternatives"))
    return best.select("id", F.col("b.src").alias("via"), F.col("b.kind").alias("kind"), (-F.col("b.w")).alias("strength"), "alternatives")


def chain(edges: DataFrame, start: str, depth: int = V.CHAIN_DEPTH, follow_inferred: bool = True) -> tuple[DataFrame, str]:
    """Provenance: from a node along the strongest incoming edges, at most ``depth`` hops, and
    why it ended. One row per hop reaches the driver."""
    spark = edges.sparkSession
    steps, node, seen, note = [], start, {start}, ""
    for d in range(1, depth + 1):
        got = strongest_incoming(edges.where(touches(edges, "dst", node)), follow_inferred).first()
        if got is None:
            note = f"nothing in the index points at {node}; the chain ends here"
            break
        if got["via"] in seen:
            note = f"the chain returns to {got['via']}; it stops rather than looping"
            break
        seen.add(got["via"])
        steps.append((d, got["via"], got["kind"], got["strength"], got["alternatives"]))
        node = got["via"]
        if d == depth:
            note = f"the chain stopped at the requested depth of {d} hops; it may go on"
    return spark.createDataFrame(steps, "distance int, id string, kind string, strength int, alternatives long"), note
