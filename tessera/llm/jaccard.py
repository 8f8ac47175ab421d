"""Exact Jaccard join of shingle sets by set relations.

1. Equal sets are one class (by a 128-bit digest of the set), whose smallest id stands for it.
2. Answer level: representatives with a minimum hash in common are compared inside bounded
   groups, each with the components that its group has so far. A member takes over its
   leader's answers, so pairs inside a component are never looked at again.
3. Index level: prefix tokens (rare ones first) that two or more sets hold give index lists.
   A list is sorted by set size and position; in each size block only the band of positions
   that a linked pair's common token can have is read, and the rest is skipped. Entries of
   the same component are skipped too. Each set has a small histogram of its tokens; sets
   whose histograms can't have enough in common go, and so do pairs with too few common
   prefix tokens. What remains is verified on whole sets. A set's commonest prefix tokens
   (passages that many texts share) have no lists: fewer are left out than a linked pair has
   in common.

A prefix leaves out the last ceil(t n) - l tokens of n, with l = 1 + n // 10: a linked pair has
at least l of the smaller set's common tokens in both prefixes, whatever the order of
tokens. So the links found connect exactly the sets that chains of links connect.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text_arrow import chunks, forget, release
from tessera.runtime import checkpoint, connected_components, read_table, ship_package

#: Places of the id filters that are sent to executors: eight for each id, 2^26 (8 MB) at most.
FILTER_BITS = 26
FILTER_LEAST = 16
#: Most members of a group that is compared in one task; larger ones are split.
GROUP = 4000
LIST = 2048
#: Lists of at most so many entries are worked on together.
SMALL = 24
#: Pairs of a bucket that are held before their counts are summed.
PAIRS_HELD = 400_000
#: Shingles to a bucket of lists; few buckets, as a pair comes once from each that it meets in.
BUCKET = 6_000_000
HASHES = 4
#: Members that a component sends into a group of the second round.
ENVOYS = 3
#: Groups of more than GROUP members that are split; beyond so many, a group is one task.
HOT_MOST = 100_000
#: Tokens that so many sets of one chunk hold are counted over all chunks and go last.
HEAVY_IN_CHUNK = 8
HEAVY_MOST = 100_000


def _pick(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))


def _signatures(width: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        from tessera.llm.shingles import flat_sets, histogram, min_hashes

        forget()
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                flat, ends = flat_sets(texts, width)
                sets = [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                sig = min_hashes(flat, ends, HASHES)
                token, times = np.unique(flat, return_counts=True)
                often = times >= HEAVY_IN_CHUNK
                heavy, count = token[often].astype(np.int64), times[often]
                n, h = len(sets), len(heavy)
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([part.column("i").cast(pa.int64()), pa.nulls(h, pa.int64())]),
                    pa.array([len(s) for s in sets] + count.tolist(), pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets] + [None] * h, pa.binary()),
                    pa.array(sig + [[x] for x in heavy.tolist()], pa.list_(pa.int64())),
                    pa.array([histogram(s) for s in sets] + [None] * h, pa.binary()),
                ], names=["i", "n", "fp", "sig", "hist"])

    return run


class IdFilter:
    """Bits at the places of hashed keys: false hits, no misses. At most 2^20 words reach the driver."""

    def __init__(self, places: DataFrame):
        """``places`` has the column h, from 0 to 2^FILTER_BITS."""
        bits = min(FILTER_BITS, max(FILTER_LEAST, (8 * places.count()).bit_length()))
        self.shift = FILTER_BITS - bits
        words = places.select(F.expr(f"shiftright(h, {self.shift})").alias("h")).select(F.expr("cast(shiftright(h, 6) AS INT)").alias("w"), F.expr("shiftleft(1L, cast(h & 63 AS INT))").alias("b"))
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.table = np.zeros(1 << (bits - 6), np.int64)
        self.table[got.column("w").to_numpy()] = got.column("b").to_numpy()

    def __call__(self, h: np.ndarray) -> np.ndarray:
        h = h >> self.shift
        return ((self.table[h >> 6] >> (h & 63)) & 1).astype(bool)


def _place(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))


def _sent(keys: DataFrame):
    return keys.sparkSession.sparkContext.broadcast(IdFilter(keys))


def _asked(batches, wanted):
    """The rows of each batch whose place (h) may be wanted, in chunks of whole texts."""
    import pyarrow as pa

    for batch in batches:
        batch = batch.filter(pa.array(wanted.value(batch.column("h").to_numpy(zero_copy_only=False))))
        yield from chunks(batch, "t")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(i, s): the sets of the texts whose ids may be among ``ids``; the rest isn't shuffled."""
    wanted = _sent(ids.select(_place("i").alias("h")))

    def run(batches):
        import pyarrow as pa

        from tessera.llm.shingles import shingle_sets

        for part, texts in _asked(batches, wanted):
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], names=["i", "s"])

    return docs.select("i", "t", _place("i").alias("h")).mapInArrow(run, "i long, s binary")


def part_of(i: int, n: int) -> int:
    """The part of a split group that an id goes to; the same as pmod(xxhash64(i), n) in SQL."""
    import xxhash

    h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % n


def _grouped_sets(docs: DataFrame, nodes: DataFrame, hot: dict, width: int) -> DataFrame:
    """(g, part, i, s): the sets of the texts of ``nodes`` (i, v), once for each minimum hash that
    the nodes name; groups in ``hot`` are dealt over parts by the id."""
    named = _sent(nodes.select(F.pmod("v", F.lit(1 << FILTER_BITS)).alias("h")).distinct())
    wanted = _sent(nodes.select(_place("i").alias("h")))
    parts = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        import pyarrow as pa

        from tessera.llm.shingles import flat_sets, min_hashes

        for part, texts in _asked(batches, wanted):
            flat, ends = flat_sets(texts, width)
            sets = [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            out = []
            for i, s, sig in zip(part.column("i").to_pylist(), sets, min_hashes(flat, ends, HASHES)):
                for v, hit in zip(sig, named.value(np.array(sig, np.int64) % (1 << FILTER_BITS))):
                    if hit:
                        out.append((v, part_of(i, parts.value.get(v, 1)), i, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()),
                                              pa.array([x[3] for x in out], pa.binary())], names=["g", "part", "i", "s"])

    return docs.select("i", "t", _place("i").alias("h")).mapInArrow(run, "g long, part int, i long, s binary")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _group_links(percent: int):
    """Links inside a bounded group: each set against the members of the components so far,
    the component of its best first member first, until one links."""

    def run(table):
        import pyarrow as pa

        from tessera.llm.shingles import similar

        ids = table.column("i").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        blobs = table.column("s").to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in blobs]
        parts: list[list[int]] = []
        a, b = [], []
        met: set = set()
        for k in order:
            if blobs[k] in met:  # equal sets are one class
                continue
            met.add(blobs[k])
            joined = None
            for p in parts:
                for m in p:
                    x, y = len(sets[k]), len(sets[m])
                    if 100 * min(x, y) < percent * max(x, y):
                        continue
                    if similar(x, y, _shared(sets[k], sets[m]), percent):
                        a.append(ids[k])
                        b.append(ids[m])
                        if joined is None:
                            joined = p
                            p.append(k)
                        else:
                            joined += p
                            p.clear()
                        break
            if joined is None:
                parts.append([k])
            parts = [p for p in parts if p]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _round(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links inside the groups of ``nodes`` (i, v)."""
    counts = nodes.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > GROUP)
    hot = {r["v"]: -(-r["c"] // GROUP) for r in counts.orderBy(F.desc("c"), "v").limit(HOT_MOST).collect()}
    return checkpoint(_grouped_sets(docs, nodes, hot, width).groupBy("g", "part").applyInArrow(_group_links(percent), "a long, b long"))


def _members(reps: DataFrame) -> DataFrame:
    """(i, v, c) of the nodes whose minimum hash another node has too, and how many have it."""
    own = reps.select("i", F.explode("sig").alias("v"))
    return own.join(own.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "v").select("i", "v", "c")


def _envoys(label: DataFrame, members: DataFrame) -> DataFrame:
    """(i, v): of each split group, some members of each of its components."""
    own = members.where(F.col("c") > GROUP).select("i", "v").join(label.select("i", "c"), "i")
    mixed = own.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v")
    few = own.join(mixed, "v").groupBy("v", "c").agg(*[F.min(F.when(F.pmod(F.xxhash64("i"), F.lit(ENVOYS)) == k, F.col("i"))).alias(f"i{k}") for k in range(ENVOYS)])
    return few.select("v", F.explode(F.array(*[f"i{k}" for k in range(ENVOYS)])).alias("i")).where("i IS NOT NULL").select("i", "v")


def _prefixes(width: int, percent: int, heavy: dict, buckets: int, wanted):
    def run(batches):
        import pyarrow as pa

        from tessera.llm.shingles import flat_sets

        keys = np.array(sorted(heavy.value), np.int64).astype(np.uint64)
        keys.sort()
        rank = np.array([heavy.value[int(np.int64(k.astype(np.int64)))] for k in keys], np.int64)
        for part, texts in _asked(batches, wanted):
            flat, ends = flat_sets(texts, width)
            size = np.diff(ends)
            doc = np.repeat(np.arange(len(size)), size)
            if len(keys) and len(flat):  # frequent tokens go last, the commonest at the end
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                often = np.flatnonzero(keys[at] == flat)
                rare = np.ones(len(flat), bool)
                rare[often] = False
                before = np.concatenate([[0], np.cumsum(rare)])
                order = np.empty(len(flat), np.int64)
                order[(ends[doc] + before[:-1] - before[ends[doc]])[rare]] = np.flatnonzero(rare)
                often = often[np.lexsort((rank[at[often]], doc[often]))]
                among = np.arange(len(often)) - np.searchsorted(doc[often], doc[often])
                order[ends[doc[often]] + before[ends[doc[often] + 1]] - before[ends[doc[often]]] + among] = often
                flat = flat[order]
            place = np.arange(len(flat)) - ends[doc]
            n = size[doc]
            pre = place < n + percent * -n // 100 + least(n)
            flat, doc, place = flat[pre], doc[pre], place[pre] * 4096 // n[pre]
            # the token's upper 52 bits, and its place in 4096ths of the set
            packed = (flat & ~np.uint64(4095)) | place.astype(np.uint64)
            bucket = ((flat >> np.uint64(12)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(doc * buckets + bucket, kind="stable")
            key = (doc * buckets + bucket)[order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            owner = key[cut] // buckets
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(key)).astype(np.int32)), pa.array(packed[order].astype(np.int64)))
            ids = part.column("i").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array((key[cut] % buckets).astype(np.int32)), pa.array(ids[owner]), pa.array(size[owner].astype(np.int32)), lists],
                                             names=["bucket", "i", "n", "tokens"])

    return run


def least(n: int) -> int:
    """Common prefix tokens that a link with a set of ``n`` as the smaller one has at least."""
    return 1 + n // 10


def _shared_tokens(table):
    """Postings of the tokens that two or more rows of the bucket hold."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tokens = table.column("tokens").combine_chunks()
    row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(tokens).to_numpy(zero_copy_only=False)
    word = flat >> 12
    order = np.argsort(word, kind="stable")
    sorted_ = word[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, int)
    count = np.diff(np.append(edge, len(sorted_)))
    keep = order[np.repeat(count > 1, count)]
    many = np.repeat(count, count)[np.repeat(count > 1, count)]
    release()
    return pa.table({"w": pa.array(flat[keep] & ~np.int64(4095)), "i": pa.array(table.column("i").to_numpy()[row[keep]]),
                     "n": pa.array(table.column("n").to_numpy()[row[keep]], pa.int32()), "p": pa.array((flat[keep] & 4095).astype(np.int32)), "m": pa.array(many.astype(np.int32))})


def _spread(percent: int, buckets: int):
    """Postings (w, i, n, p, m) and nodes (i, c, gs, hist) of some ids -> a row for each set and
    bucket of lists: (bucket, i, n, l, c, gs, hist). Postings of other ids go; so do a set's commonest
    tokens, fewer than least() of any set that can link, so a pair's rarest common token stays.
    A long list is cut into blocks, and each pair of blocks is a list."""

    def run(left, right):
        import pyarrow as pa

        from tessera.llm.shingles import mix

        def column(name):
            return left.column(name).to_numpy()

        kind = pa.list_(pa.struct([("w", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("blk", pa.int32()), ("p", pa.int32())]))
        w, i, n, p, m = (column(x) for x in "winpm")
        known = right.column("i").to_numpy()
        by = np.argsort(known, kind="stable")
        at = np.minimum(np.searchsorted(known[by], i), max(0, len(known) - 1))
        mine = known[by][at] == i if len(known) else np.zeros(len(i), bool)
        w, i, n, p, m, at = (x[mine] for x in (w, i, n, p, m, by[at] if len(known) else at))
        order = np.lexsort((w, -m, i))
        w, i, n, p, m, at = (x[order] for x in (w, i, n, p, m, at))
        fresh = np.ones(len(w), np.int64)
        fresh[1:] = (w[1:] != w[:-1]) | (i[1:] != i[:-1])
        total = np.cumsum(fresh)
        start = np.searchsorted(i, i)
        rank = total - total[start] + 1 if len(w) else total
        keep = rank > n.astype(np.int64) * percent // 100 // 16
        w, i, n, p, m, at = (x[keep] for x in (w, i, n, p, m, at))
        k = -(-m.astype(np.int64) // LIST)
        own = (mix(i.astype(np.uint64)) % k.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(w)), k)
        other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
        w, i, n, p, at, own = (x[again] for x in (w, i, n, p, at, own))
        lo, hi = np.minimum(own, other), np.maximum(own, other)
        bucket = (mix(w.astype(np.uint64) ^ mix((lo * 65536 + hi).astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((bucket, n, i))
        w, i, n, p, at, own, lo, hi, bucket = (x[order] for x in (w, i, n, p, at, own, lo, hi, bucket))
        cut = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (n[1:] != n[:-1]) | (bucket[1:] != bucket[:-1])])) if len(i) else np.zeros(0, np.int64)
        flat = pa.StructArray.from_arrays([pa.array(w), *(pa.array(x.astype(np.int32)) for x in (lo, hi, own, p))], names=["w", "lo", "hi", "blk", "p"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(i)).astype(np.int32)), flat).cast(kind)
        node = right.select(["c", "gs", "hist"]).take(pa.array(at[cut]))
        release()
        return pa.table({"bucket": pa.array(bucket[cut]), "i": pa.array(i[cut]), "n": pa.array(n[cut].astype(np.int32)), "l": lists, "c": node.column("c"), "gs": node.column("gs").cast(pa.list_(pa.int64())), "hist": node.column("hist")})

    return run


def _pairs(percent: int):
    """(a, b, na, nb, k): pairs of different components and their common tokens in a bucket."""

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        from tessera.llm.shingles import Histograms

        ids, size_of, part_of_row = (table.column(x).to_numpy() for x in ("i", "n", "c"))
        size_of = size_of.astype(np.int64)
        postings = table.column("l").combine_chunks()
        row = pc.list_parent_indices(postings).to_numpy(zero_copy_only=False)
        w, lo, hi, blk, p = (x.to_numpy(zero_copy_only=False) for x in postings.flatten().flatten())
        hists = Histograms(table.column("hist"))
        groups = np.zeros((len(ids), HASHES), np.int64)
        for k, gs in enumerate(table.column("gs").to_pylist()):
            if gs:
                groups[k, : len(gs)] = gs
        order = np.lexsort((ids[row], p, size_of[row], hi, lo, w))
        row, w, lo, hi, blk, p = (x[order] for x in (row, w, lo, hi, blk, p))
        starts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])) if len(w) else np.zeros(0, np.int64)
        out: list = []
        held = [0]

        def summed() -> np.ndarray:
            """Rows (row, row, common tokens) of the pairs met so far that can link."""
            if not out:
                return np.zeros((0, 3), np.int64)
            met = np.concatenate(out)
            pair, at = np.unique(met[:, 0] * len(ids) + met[:, 1], return_inverse=True)
            x, y, k = pair // len(ids), pair % len(ids), np.bincount(at, weights=met[:, 2]).astype(np.int64)
            need = -(-percent * (size_of[x] + size_of[y]) // (100 + percent))
            ok = hists.most(x, y) >= need
            return np.column_stack([x[ok], y[ok], k[ok]])

        if len(starts):
            size = np.diff(np.append(starts, len(w)))
            c = part_of_row[row]
            mixed = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
            rows = np.repeat(mixed, size)  # lists of one component give nothing
            row, lo, hi, blk, p, c = row[rows], lo[rows], hi[rows], blk[rows], p[rows], c[rows]
            n = size_of[row]
            size = size[mixed]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size

            def keep(x, y):
                """Pairs of postings (x sorted before y) that may link and weren't compared."""
                b, a, q, r = n[x], n[y], p[x].astype(np.int64), p[y].astype(np.int64)
                need = -(-percent * (a + b) // (100 + percent))
                # places in tokens, at least and at most; either set lacks at most so many tokens
                ok = (c[x] != c[y]) & (100 * b >= percent * a) & ((r + 1) * a // 4096 + 1 + (b - need) >= q * b // 4096) & ((q + 1) * b // 4096 + 1 + (a - need) >= r * a // 4096)
                ok &= (lo[x] == hi[x]) | (blk[x] != blk[y])
                u, v = row[x[ok]], row[y[ok]]
                met = ((groups[u][:, :, None] == groups[v][:, None, :]) & (groups[u] != 0)[:, :, None]).any(axis=(1, 2))
                u, v = u[~met], v[~met]
                if len(u):
                    out.append(np.column_stack([np.minimum(u, v), np.maximum(u, v), np.ones(len(u), np.int64)]))
                    held[0] += len(u)
                    if held[0] > PAIRS_HELD:
                        out[:] = [summed()]
                        held[0] = len(out[0]) // 2  # summed rows are half as pressing

            for m in np.unique(size).tolist():
                at = starts[size == m]
                if m <= SMALL:  # short lists of one length at once
                    left, right = np.triu_indices(m, 1)
                    step = max(1, 100_000 // len(left))
                    for k in range(0, len(at), step):
                        base = at[k : k + step, None]
                        keep((base + left).ravel(), (base + right).ravel())
                    continue
                for s in at.tolist():
                    e = s + m
                    sizes, blocks = np.unique(n[s:e], return_index=True)
                    blocks = np.append(blocks, m)
                    for k in range(m):
                        a, r = int(n[s + k]), int(p[s + k])
                        x, y = [], []
                        for j in range(int(np.searchsorted(sizes, -(-percent * a // 100))), int(np.searchsorted(sizes, a, side="right"))):
                            b, first, last = int(sizes[j]), s + int(blocks[j]), s + min(int(blocks[j + 1]), k)
                            if first >= last:
                                continue
                            # only the band of places that a common token can have, in this block
                            need = -(-percent * (a + b) // (100 + percent))
                            low = (r * a // 4096 - (a - need) - 2) * 4096 // b - 1
                            high = ((r + 1) * a // 4096 + (b - need) + 3) * 4096 // b + 1
                            u = first + int(np.searchsorted(p[first:last], low))
                            v = first + int(np.searchsorted(p[first:last], high, side="right"))
                            x.append(np.arange(u, v))
                        if x:
                            x = np.concatenate(x)
                            keep(x, np.full(len(x), s + k))
        got = summed()
        release()
        u, v = got[:, 0], got[:, 1]
        swap = ids[u] > ids[v]
        u, v = np.where(swap, v, u), np.where(swap, u, v)
        return pa.table({"a": pa.array(ids[u]), "b": pa.array(ids[v]), "na": pa.array(size_of[u].astype(np.int32)), "nb": pa.array(size_of[v].astype(np.int32)), "k": pa.array(got[:, 2])})

    return run


def _verify(percent: int):
    def run(batches):
        import pyarrow as pa

        from tessera.llm.shingles import similar

        for batch in batches:
            good = []
            for x, y in zip(batch.column("s").to_pylist(), batch.column("r").to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                good.append(similar(len(u), len(v), _shared(u, v), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """id, n_shingles and component_id of every row.

    Sets link when 100 * shared >= percent * (size of the union). Empty sets (null texts,
    texts without words) link with nothing. Rows with the same id are one node of the
    graph; a null id gets a null component.
    """
    spark = docs.sparkSession
    ship_package(spark)
    picked = _pick(docs, id_col, text_col)
    light = checkpoint(picked.mapInArrow(_signatures(width), "i long, n long, fp binary, sig array<long>, hist binary"))
    rows = light.where("i IS NOT NULL")
    top = light.where("i IS NULL").select(F.col("sig")[0].alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(HEAVY_MOST).collect()
    heavy = spark.sparkContext.broadcast({r["w"]: k for k, r in enumerate(reversed(top))})
    full = rows.where("n > 0")
    classes = full.groupBy("fp").agg(F.min("i").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = checkpoint(classes)
    reps = classes.select(F.col("rep").alias("i"), "sig").dropDuplicates(["i"])
    # answer level; where groups were split, a second round links the components of the parts
    members = checkpoint(_members(reps))
    links = _round(picked, members, width, percent)
    label = _labels(reps, links)
    if not members.where(F.col("c") > GROUP).isEmpty():
        label = checkpoint(label)
        links = links.unionByName(_round(picked, checkpoint(_envoys(label, members)), width, percent))
        label = _labels(reps, links)
    # pairs of one part of a group have been compared: the lists needn't give them again
    group = F.xxhash64("v", F.pmod(F.xxhash64("i"), F.expr(f"cast(ceil(c / {GROUP}) AS BIGINT)")))
    groups = members.groupBy("i").agg(F.collect_set(group).alias("gs"))
    label = checkpoint(label.select("i", "c").join(groups, "i", "left"))
    # index level: only representatives have lists
    total = int(classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    buckets = max(32, total // 4_000_000)
    wanted = _sent(reps.select(_place("i").alias("h")))
    posted = picked.select("i", "t", _place("i").alias("h")).mapInArrow(_prefixes(width, percent, heavy, buckets, wanted), "bucket int, i long, n int, tokens array<long>")
    lists = posted.groupBy("bucket").applyInArrow(_shared_tokens, "w long, i long, n int, p int, m int")
    # an id with several texts has no histogram of its own
    hists = full.groupBy("i").agg(F.when(F.min("fp") == F.max("fp"), F.first("hist")).alias("hist"))
    near = F.pmod(F.xxhash64("i"), F.lit(buckets)).alias("near")
    packed = lists.groupBy(near).cogroup(label.join(hists, "i").groupBy(near)).applyInArrow(
        _spread(percent, max(6, total // BUCKET)), "bucket int, i long, n int, l array<struct<w: long, lo: int, hi: int, blk: int, p: int>>, c long, gs array<long>, hist binary")
    pairs = packed.groupBy("bucket").applyInArrow(_pairs(percent), "a long, b long, na int, nb int, k long").groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    pairs = checkpoint(pairs.where(F.expr(f"k >= greatest(1, 1 + least(na, nb) div 10 - (greatest(na, nb) * {percent} div 100) div 16)")).select("a", "b").distinct())
    if not pairs.isEmpty():
        ends = pairs.select(F.col("a").alias("i")).unionByName(pairs.select(F.col("b").alias("i"))).distinct()
        sets = _sets(picked, ends, width).join(ends, "i", "left_semi")
        both = pairs.join(sets.withColumnRenamed("i", "a"), "a").join(sets.select(F.col("i").alias("b"), F.col("s").alias("r")), "b")
        links = links.unionByName(both.select("a", "b", "s", "r").mapInArrow(_verify(percent), "a long, b long"))
    return _answer(docs, id_col, rows, classes, connected_components(checkpoint(links)))


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    parts = connected_components(links)
    return reps.join(parts, reps["i"] == parts["id"], "left").select("i", "sig", F.coalesce("component", "i").alias("c"))


def _answer(docs, id_col, rows, classes, parts) -> DataFrame:
    named = rows.where("n > 0").join(classes.select("fp", "rep"), "fp").join(parts, F.col("rep") == F.col("id"), "left").select("i", "n", F.coalesce("component", "rep").alias("c"))
    empty = rows.where("n = 0").select("i", "n", F.col("i").alias("c"))
    lost = docs.where(docs[id_col].isNull()).select(docs[id_col].cast("long").alias("i"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("c"))
    out = named.unionByName(empty).unionByName(lost)
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each group, as it came; a null id comes last.

    Each pair of id and text is a document of its own, known by a 64-bit hash: rows that share
    an id but not the text are compared like any others, and so are rows without an id. Of
    rows equal in id and text one stays.
    """
    keyed = docs.withColumn("__key", F.xxhash64(docs[id_col], docs[text_col]))
    parts = jaccard_components(keyed.select("__key", text_col), id_col="__key", text_col=text_col, **options).select("__key", "component_id").distinct()
    named = keyed.select("__key", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("i"), F.col("__key").alias("k")).alias("x"))
    stays = named.join(parts, "__key").groupBy("component_id").agg(F.min("x").alias("x")).select(F.col("x.k").alias("__stays"))
    return keyed.join(stays, keyed["__key"] == stays["__stays"], "left_semi").dropDuplicates(["__key"]).drop("__key")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
