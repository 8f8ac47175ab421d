"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors of a label are one node. Nodes are dealt to overlapping cluster shards around
sampled pivots; in each shard a graph is built and robust-pruned, and the adjacency lists of
a node's shards are united. A shard is small, so candidates for pruning are all its nodes:
SHARD comparisons a node, at any size of the input. Every node is then searched in its home
shard: greedy from the shard's medoid and its own list, widening to all neighbours of
whatever lies within the range. Links between two nodes at home in a shard are counted and
spanned there and not listed, so a group of close copies makes no more rows than it has
members. A shard that pivots do not split is compared in full, in blocks of two bounded
parts. Links are verified in double precision. ``audit_recall`` measures what was missed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import checkpoint, connected_components, read_table, ship_package

LEAST = 0.93
#: Nodes of a shard at which it is split further, and pivots of a split at most.
SHARD = 512
PIVOTS = 64
LEVELS = 5
#: A node also joins shards whose pivot is nearly as close as the closest one.
MARGIN = 0.12
#: Of two pivots that are closer than this, one is enough.
CLOSE = 0.88
#: A split has so many times the rows of its shard at most, and its parts above the bound so
#: large a share of them.
OVERLAP = 4
SHRUNK = 0.75
DEGREE = 24
ALPHA = 1.2
BEAM = 24
#: Pivot rows up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_PIVOTS = 20_000


def _matrix(column) -> np.ndarray:
    """list<float> column -> one row per list (all of one length), in double precision."""
    import pyarrow as pa

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(c), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that neither tiny nor huge components leave the range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(vectors: list) -> np.ndarray:
    """The pivots that are not close to one before them."""
    x = _unit(np.array(vectors, float))
    kept: list[int] = []
    for k in range(len(x)):
        if not kept or (x[kept] @ x[k]).max() < CLOSE:
            kept.append(k)
    return x[kept]


def _assign(margin: float):
    """Rows with the pivots of their shard -> rows with the parts they go to, the closest first."""

    def run(batches):
        import pyarrow as pa

        known: tuple = (None, None)
        for batch in batches:
            parts = []
            for shard, v, pivots in zip(*(batch.column(c).to_pylist() for c in ("shard", "v", "pivots"))):
                if known[0] != shard:
                    known = shard, _pivots(pivots)
                cos = known[1] @ _unit(np.array([v], float))[0]
                best = int(cos.argmax())
                parts.append([best, *(k for k in np.flatnonzero(cos >= cos[best] - margin).tolist() if k != best)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "i", "v", "home")), pa.array(parts, pa.list_(pa.int32()))], names=["shard", "i", "v", "home", "ks"])

    return run


def _cluster(nodes: DataFrame, most: int) -> DataFrame:
    """(shard, i, v, home): splits shards of more than ``most`` nodes around sampled pivots, level
    by level. A split that multiplies its shard's rows by more than OVERLAP, or leaves a part
    above ``most`` that has more than SHRUNK of them (close copies of one vector, or vectors
    equally far from all pivots), is not made: the shard stays whole and above ``most``."""
    rows = nodes.select(F.col("g").alias("shard"), "i", "v", F.lit(True).alias("home"))
    done = None
    for level in range(LEVELS):
        sizes = rows.groupBy("shard").agg(F.count("*").alias("m"))
        large = sizes.where(F.col("m") > most)
        if large.isEmpty():
            break
        small = rows.join(large, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        want = F.least(F.ceil(F.col("m") / F.lit(most / 4)), F.lit(PIVOTS))
        draw = F.pmod(F.xxhash64(F.lit(level), "i"), F.lit(1 << 30))
        picked = rows.join(F.broadcast(large) if large.count() <= BROADCAST_PIVOTS else large, "shard")
        pivots = picked.where(draw < want / F.col("m") * (1 << 30)).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s")).select("shard", F.col("s.v").alias("pivots"))
        pivots = checkpoint(pivots)
        few = (pivots.agg(F.sum(F.size("pivots"))).first()[0] or 0) <= BROADCAST_PIVOTS
        whole = rows.join(large, "shard", "left_semi").join(pivots.select("shard"), "shard", "left_anti")
        done = done.unionByName(whole)
        # vectors are copied only for the splits that are made
        dealt = checkpoint(rows.join(F.broadcast(pivots) if few else pivots, "shard").mapInArrow(_assign(MARGIN), "shard string, i long, v array<double>, home boolean, ks array<int>"))
        parts = dealt.select("shard", F.explode("ks").alias("k")).groupBy("shard", "k").agg(F.count("*").alias("n"))
        judged = parts.groupBy("shard").agg(F.sum("n").alias("total"), F.max("n").alias("top")).join(dealt.groupBy("shard").agg(F.count("*").alias("m")), "shard")
        made = checkpoint(judged.where((F.col("total") <= OVERLAP * F.col("m")) & ((F.col("top") <= most) | (F.col("top") <= SHRUNK * F.col("m")))).select("shard"))
        done = done.unionByName(dealt.join(made, "shard", "left_anti").drop("ks"))
        rows = dealt.join(made, "shard", "left_semi").select("shard", "i", "v", "home", F.posexplode("ks").alias("at", "k"))
        rows = checkpoint(rows.select(F.concat_ws("/", "shard", F.col("k").cast("string")).alias("shard"), "i", "v", (F.col("home") & (F.col("at") == 0)).alias("home")))
    return rows if done is None else done.unionByName(rows)


def _clumps(shards: DataFrame, large: DataFrame, nodes: DataFrame, most: int, least: float) -> DataFrame:
    """Shards above ``most`` in disjoint parts of about ``most`` by a hash; every two parts meet in a
    task of their own and are compared in full. (kind, a, b): links of two home nodes are not
    listed but counted (0: node, copies it links with) and spanned (1: node, smaller node of
    its component); those of a home node with another are listed (2)."""
    rows = shards.join(large, "shard").join(nodes.select("i", "times"), "i").withColumn("k", F.ceil(F.col("m") / most).cast("int"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64(F.lit("part"), "i"), F.col("k")).cast("int")).withColumn("q", F.explode(F.expr("sequence(0, k - 1)")))
    blocks = rows.select("shard", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "i", "v", "home", "times")
    return blocks.groupBy("shard", "lo", "hi").applyInArrow(_block(least), "kind int, a long, b long")


def _block(least: float):
    def run(key, table):
        import pyarrow as pa

        lo, hi = (int(k.as_py()) for k in key[1:])
        order = np.argsort(table.column("i").to_numpy(), kind="stable")
        ids = table.column("i").to_numpy()[order]
        x = _unit(_matrix(table.column("v")))[order]
        home = np.array(table.column("home").to_pylist(), bool)[order]
        times = table.column("times").to_numpy()[order]
        first = table.column("p").to_numpy()[order] == lo
        rows = np.flatnonzero(first)
        columns = rows if lo == hi else np.flatnonzero(~first)
        others, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        y = x[columns]
        for start in range(0, len(rows), 256):
            r = rows[start : start + 256]
            ok = x[r] @ y.T >= least
            if lo == hi:
                ok &= columns[None, :] > r[:, None]
            inner = ok & home[r][:, None] & home[columns][None, :]
            others[r] += inner @ times[columns]
            others[columns] += times[r] @ inner
            for k in np.flatnonzero(inner.any(axis=1)).tolist():
                met = label[columns[inner[k]]]
                low, high = min(int(met.min()), int(label[r[k]])), max(int(met.max()), int(label[r[k]]))
                if low != high:
                    old = np.zeros(len(ids), bool)
                    old[met] = old[label[r[k]]] = True
                    label[old[label]] = low
            ok &= home[r][:, None] != home[columns][None, :]
            i, j = np.nonzero(ok)
            u, v = ids[r[i]], ids[columns[j]]
            a.append(np.minimum(u, v))
            b.append(np.maximum(u, v))
        some, tied = np.flatnonzero(others), np.flatnonzero(label != np.arange(len(ids)))
        a, b = np.concatenate(a), np.concatenate(b)
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(some), len(tied), len(a)])
        return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate([ids[some], ids[tied], a])), "b": pa.array(np.concatenate([others[some], ids[label[tied]], b]))})

    return run


def _prune(order: np.ndarray, cos_row: np.ndarray, x: np.ndarray) -> list[int]:
    """Robust pruning: the closest candidate stays and drops those that it is closer to, by
    ALPHA, than the node is."""
    kept: list[int] = []
    left = order
    dist = np.arccos(np.clip(cos_row[order], -1, 1))
    while len(left) and len(kept) < DEGREE:
        p = int(left[0])
        kept.append(p)
        far = ALPHA * np.arccos(np.clip(x[left] @ x[p], -1, 1)) > dist
        far[0] = False
        left, dist = left[far], dist[far]
    return kept


def _build(table):
    """Adjacency of one shard: (i, [j, ...]) with edges in both directions."""
    import pyarrow as pa

    ids = table.column("i").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    x = _unit(_matrix(table.column("v")))[order]
    n = len(ids)
    edges: list[set] = [set() for _ in range(n)]
    for start in range(0, n, 256):
        cos = x[start : start + 256] @ x.T
        for k in range(len(cos)):
            node = start + k
            cos[k, node] = -2
            most = min(n - 1, 3 * DEGREE)
            if most <= 0:
                continue
            near = np.argpartition(-cos[k], most - 1)[:most]
            near = near[np.argsort(-cos[k, near], kind="stable")]
            for p in _prune(near, cos[k], x):
                edges[node].add(p)
                edges[p].add(node)
    return pa.table({"i": pa.array(ids, pa.int64()), "near": pa.array([[int(ids[p]) for p in sorted(e)] for e in edges], pa.list_(pa.int64()))})


def _search(least: float):
    def run(table):
        """Links of the shard's home nodes, found over the united adjacency lists: rows of the
        kinds that _clumps has."""
        import heapq

        import pyarrow as pa

        ids = table.column("i").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = _unit(_matrix(table.column("v")))[order]
        home = np.array(table.column("home").to_pylist(), bool)[order]
        place = {int(i): k for k, i in enumerate(ids)}
        times = table.column("times").to_numpy()[order]
        near = table.column("near").to_pylist()
        lists = [np.array([place[j] for j in near[o] or [] if j in place], np.int64) for o in order]
        medoid = int((x @ x.mean(axis=0)).argmax())
        linked = np.zeros((len(ids), len(ids)), bool)  # of a bounded shard
        for q in np.flatnonzero(home).tolist():
            seen = np.zeros(len(ids), bool)
            heap: list = []
            best: list = []  # the BEAM closest so far, the farthest on top

            def meet(nodes):
                nodes = nodes[~seen[nodes]]
                if not len(nodes):
                    return
                seen[nodes] = True
                cos = x[nodes] @ x[q]
                for node, c in zip(nodes.tolist(), cos.tolist()):
                    if c >= least:
                        linked[q, node] = True
                    elif len(best) >= BEAM and c <= best[0]:
                        continue
                    heapq.heappush(heap, (-c, node))
                    (heapq.heappush if len(best) < BEAM else heapq.heappushpop)(best, c)

            seen[q] = True
            meet(np.array([medoid], np.int64))
            meet(lists[q])
            while heap:
                c, node = heapq.heappop(heap)
                if -c < least and len(best) >= BEAM and -c < best[0]:
                    break
                meet(lists[node])
        linked |= linked.T
        inner = linked & home[:, None] & home[None, :]
        label = np.arange(len(ids))
        while True:  # the smallest node that links lead to
            low = np.minimum(label, np.where(inner, label[None, :], len(ids)).min(axis=1, initial=len(ids)))
            low = low[low]
            if (low == label).all():
                break
            label = low
        others = inner @ times
        u, v = np.nonzero(linked & home[:, None] & ~home[None, :])
        some, tied = np.flatnonzero(others), np.flatnonzero(label != np.arange(len(ids)))
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(some), len(tied), len(u)])
        return pa.table({"kind": pa.array(kind), "a": pa.array(np.concatenate([ids[some], ids[tied], np.minimum(ids[u], ids[v])])),
                         "b": pa.array(np.concatenate([others[some], ids[label[tied]], np.maximum(ids[u], ids[v])]))})

    return run


def near_duplicates(rows: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD) -> DataFrame:
    """id, n_links, component_id and kept of every row.

    Rows link when their labels are equal and not null, their vectors are equally long and the
    cosine, in double precision, is ``least`` or more. Null and zero vectors, and vectors
    with null or non-finite components, link with nothing and are their own component. Equal
    vectors count as linked with each other. A null id has a null component. Ids are expected
    to be unique: rows that share one link by each of their vectors. Vectors of any length are
    taken whole; an empty table gives none; other columns may have any names.
    """
    spark = rows.sparkSession
    ship_package(spark)
    base = rows.select(rows[id_col].cast("long").alias("i"), rows[vector_col].cast("array<double>").alias("v"), rows[label_col].cast("string").alias("l"))
    fine = F.col("l").isNotNull() & F.col("v").isNotNull() & F.expr("coalesce(size(v) > 0 AND forall(v, z -> z IS NOT NULL AND NOT isnan(z) AND abs(z) < double('Infinity')) AND exists(v, z -> z <> 0), false)")
    base = base.withColumn("g", F.when(fine & F.col("i").isNotNull(), F.concat_ws(":", F.size("v").cast("string"), F.col("l"))))
    good = base.where("g IS NOT NULL")
    nodes = checkpoint(good.groupBy("g", "v").agg(F.min("i").alias("i"), F.count("*").alias("times")))
    shards = checkpoint(_cluster(nodes, shard))
    large = shards.groupBy("shard").agg(F.count("*").alias("m")).where(F.col("m") > shard)
    whole = None
    if not large.isEmpty():
        whole = _clumps(shards, large, nodes, shard, least)
        shards = shards.join(large, "shard", "left_anti")
    near = shards.select("shard", "i", "v").groupBy("shard").applyInArrow(_build, "i long, near array<long>")
    united = near.groupBy("i").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    found = shards.join(united, "i").join(nodes.select("i", "times"), "i").groupBy("shard").applyInArrow(_search(least), "kind int, a long, b long")
    found = checkpoint(found if whole is None else found.unionByName(whole))
    pairs = found.where("kind = 2").select("a", "b").distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(nodes.select(F.col("i").alias("b"), "times"), "b").select("a", "times").unionByName(found.where("kind = 0").select("a", F.col("b").alias("times")))
    links = pairs.unionByName(found.where("kind = 1").select("a", "b"))
    count = linked.groupBy(F.col("a").alias("ni")).agg(F.sum("times").alias("others"))
    parts = connected_components(links)
    answer = (
        nodes.join(count, nodes["i"] == count["ni"], "left").join(parts, nodes["i"] == parts["id"], "left")
        .select(F.col("g").alias("ng"), F.col("v").alias("nv"), (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "i").alias("c"))
    )
    named = good.join(answer, (F.col("g") == F.col("ng")) & (F.col("v") == F.col("nv"))).select("i", "n", "c")
    alone = base.where("g IS NULL").select("i", F.lit(0).cast("long").alias("n"), F.col("i").alias("c"))
    out = named.unionByName(alone)
    return out.select(F.col("i").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("i") == F.col("c"), F.lit(True)).alias("kept"))


def audit_recall(rows: DataFrame, answer: DataFrame, every: int = 50, least: float = LEAST, block: int = 4_000) -> tuple[int, int]:
    """(links found, links there are) of the rows whose id is divisible by ``every``, against all
    rows. Rows asked for are dealt to blocks of about ``block`` by a hash, rows of a label meet
    each block of their label in batches, and counts alone come back."""
    ship_package(rows.sparkSession)
    base = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("l"))
    base = base.where("size(v) > 0 AND forall(v, z -> z IS NOT NULL AND NOT isnan(z) AND abs(z) < double('Infinity')) AND exists(v, z -> z <> 0)").withColumn("l", F.concat_ws(":", F.size("v"), "l"))
    asked = base.where(F.col("i") % every == 0)
    sizes = asked.groupBy("l").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    asked = asked.join(sizes, "l").withColumn("q", F.pmod(F.xxhash64("i"), F.col("k")).cast("int")).drop("k")
    # all rows of a label in parts, each with every block of the label's rows asked for
    whole = base.groupBy("l").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).join(sizes, "l")
    left = asked.join(whole.select("l", "parts"), "l").withColumn("p", F.explode(F.expr("sequence(0, parts - 1)"))).select("l", "q", "p", "i", "v")
    right = base.join(whole, "l").withColumn("p", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.expr("sequence(0, k - 1)"))).select("l", "q", "p", "i", "v")

    def run(table):
        import pyarrow as pa

        mine = np.array(table.column("asked").to_pylist(), bool)
        if not mine.any():
            return pa.table({"i": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        ids, x = table.column("i").to_numpy(), _unit(_matrix(table.column("v")))
        ok = (x[mine] @ x[~mine].T >= least) & (ids[mine][:, None] != ids[~mine][None, :])
        return pa.table({"i": pa.array(ids[mine]), "n": pa.array(ok.sum(axis=1), pa.int64())})

    met = left.withColumn("asked", F.lit(True)).unionByName(right.withColumn("asked", F.lit(False)))
    true = met.groupBy("l", "q", "p").applyInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    both = answer.join(true, answer["vec_id"] == true["i"]).agg(F.sum("n_links"), F.sum("n")).first()
    return int(both[0] or 0), int(both[1] or 0)


def op6_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
