"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source's documents form one stream, cut into blocks of ``block`` words. The
number of slots that each source gets in an output shard is drawn: what is whole in the
expected number is dealt, and the slots left over are a multinomial draw over the fractions
(with ``residual=False`` all slots of the shard are). The slots of a source, counted over the
shards, walk through its blocks pass by pass; each pass is a Feistel permutation of its own.
Slots, blocks and documents meet by block index: what is taken of a document is what the
drawn slots hold of it, so a source misses its target by the drawn fractions, the square root
of the number of shards or so in blocks, and by its short last block.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import checkpoint, prefix_sums, read_table, ship_package

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 128
#: Slots of an output shard, and output shards at most; beyond it shards have more slots.
SLOTS_A_SHARD = 8192
MOST_SHARDS = 1024
#: Slots that a task makes at once, so that no task makes a large source's slots alone.
SLOTS_A_ROW = 50_000
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares of ``share`` times all sizes by weight; a source above ``most`` times its size
    stops there, and the excess is shared anew among the others."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        part = {i: left * weights[i % len(weights)] / total for i in open_}
        over = {i for i in open_ if part[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = part[i]
            break
        for i in sorted(over):
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def permute(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds on the least even number of
    bits, walked along cycles back into the range."""
    if n <= 1:
        return index.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(4)]
    shift, mul = np.uint64(half), np.uint64(0x9E3779B97F4A7C15)

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            h = (right ^ k) * mul
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (outside := out >= np.uint64(n)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def plan(sizes: list[int], goal: list[float], block: int = BLOCK, shards: int | None = None, seed: int = 0, most: float = MOST, residual: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Rows (output shard, source, its first slot, slots, first place in the shard) of the draw.

    No source gets more slots than ``most`` passes over its blocks have; what is drawn beyond
    that is drawn again among the others.
    """
    rng = np.random.default_rng(seed)
    size = np.array(sizes, float)
    blocks = np.array([-(-s // block) for s in sizes], np.int64)
    want = np.where(blocks > 0, np.array(goal, float) * blocks / np.maximum(size, 1), 0.0)
    room = np.floor(most * blocks).astype(np.int64)
    total = min(int(round(want.sum())), int(room.sum()))
    if not total:
        return []
    shards = max(1, min(shards or total // SLOTS_A_SHARD, total, MOST_SHARDS))
    done = np.zeros(len(sizes), np.int64)
    out = []
    for k in range(shards):
        got = _draw(rng, want, room - done, total // shards + (k < total % shards), residual)
        at = 0
        for i in np.flatnonzero(got).tolist():
            out.append((k, i, int(done[i]), int(got[i]), at))
            at += int(got[i])
        done += got
    return out


def _draw(rng, want: np.ndarray, room: np.ndarray, n: int, residual: bool) -> np.ndarray:
    """Counts of one shard: ``n`` slots in proportion to ``want``, none beyond ``room``."""
    got = np.zeros(len(want), np.int64)
    while n:
        share = np.where(room > got, want, 0.0)
        if not share.any():
            share = np.maximum(room - got, 0).astype(float)
        part = n * share / share.sum()
        new = np.floor(part).astype(np.int64) if residual else np.zeros(len(want), np.int64)
        left = n - int(new.sum())
        if left:
            rest = part - new
            new = new + rng.multinomial(left, rest / rest.sum() if rest.sum() > 0 else share / share.sum())
        new = np.minimum(new, room - got)
        got, n = got + new, n - int(new.sum())
    return got


def _slots(sizes: list[int], block: int, seed: int):
    """Rows of the plan -> the block of each slot, and how often its pass has come before."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, s, first, at, m in zip(*(c.to_pylist() for c in batch.columns)):
                n = -(-sizes[s] // block)
                slot = np.arange(first, first + m, dtype=np.int64)
                index = np.concatenate([permute(slot[slot // n == p] % n, n, f"{seed}:{s}:{p}") for p in range(first // n, (first + m - 1) // n + 1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, shard), pa.int32()), pa.array(np.arange(at, at + m, dtype=np.int64)), pa.array(np.full(m, s), pa.int32()), pa.array(index),
                     pa.array((slot // n).astype(np.int32))], names=["shard", "slot", "source", "block", "pass"])

    return run


def _met(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shards: int | None = None, seed: int = 0, residual: bool = True,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their source; those with words by block, with the words _from.._to of the
    block that are theirs and how often it is taken; slots: shard, slot, source, block, pass).

    Sources sort by code point, null last, and weigh ``weights`` in turn. A document's size is
    its number of words, 0 for a null text, and a document of size 0 is never taken. ``taken``
    counts repeats and is at most ``most`` (rounded up) times the size. The driver holds the
    list of sources, at most MAX_SOURCES, never of documents. The order of a source's stream
    hangs on ids and text digests alone, so reruns agree; equal rows stand next to each other.
    A null id or source is a value like others; an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    ship_package(spark)
    words = F.expr(f"regexp_count(coalesce(`{text_col}`, ''), '[^\\\\x20\\\\x09-\\\\x0D]+')").cast("long")
    base = checkpoint(docs.select(docs[id_col].alias("_id"), docs[source_col].alias("_src"), words.alias("size"), F.xxhash64(docs[text_col]).alias("_h")))
    rows = base.groupBy("_src").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["_src"] is None, str(r["_src"] or "").encode("utf-8", "replace")))
    sizes = [int(r["n"]) for r in rows]
    goal = targets(sizes, weights, share, most)
    table = spark.createDataFrame([(r["_src"], i, s, g) for i, (r, s, g) in enumerate(zip(rows, sizes, goal))],
                                  f"_name {docs.schema[source_col].dataType.simpleString()}, _n int, source_size long, target double")
    drawn = spark.createDataFrame(plan(sizes, goal, block, shards, seed, most, residual), "shard int, source int, first long, m long, at long")
    drawn = drawn.withColumn("o", F.explode(F.expr(f"sequence(0L, m - 1, {SLOTS_A_ROW}L)"))).selectExpr("shard", "source", "first + o AS first", "at + o AS at", f"least(m - o, {SLOTS_A_ROW}L) AS m")
    slots = drawn.repartition("shard", "source", "first").mapInArrow(_slots(sizes, block, seed), "shard int, slot long, source int, block long, pass int")
    taken = slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count("*").alias("times"))
    numbered = base.join(F.broadcast(table), F.col("_src").eqNullSafe(F.col("_name"))).drop("_name")
    placed = prefix_sums(numbered.where("size > 0"), ["_n"], ["_id", "_h", "size"], F.col("size"), "_at")
    met = (
        placed.select("*", F.explode(F.expr(f"sequence(_at div {block}, (_at + size - 1) div {block})")).alias("_b"))
        .join(taken.hint("merge"), (F.col("_n") == F.col("s")) & (F.col("_b") == F.col("b")), "left")
        .withColumn("_from", F.greatest(F.col("_at") - F.col("_b") * block, F.lit(0)))
        .withColumn("_to", F.least(F.col("_at") + F.col("size") - F.col("_b") * block, F.lit(block)))
        .withColumn("_times", F.coalesce("times", F.lit(0)).cast("long"))
    )
    return numbered, met, slots


def mix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(rows: _id, _src, _h, size, source_size, target, taken; slots: shard, slot, source,
    block, pass) of the mix that ``_met`` draws."""
    numbered, met, slots = _met(docs, **options)
    got = (
        met.withColumn("_w", F.col("_times") * (F.col("_to") - F.col("_from")))
        .groupBy("_n", "_at", "_id", "_src", "_h", "size", "source_size", "target").agg(F.sum("_w").cast("long").alias("taken"))
    )
    columns = ["_id", "_src", "_h", "size", "source_size", "target", "taken"]
    none = numbered.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return got.select(*columns).unionByName(none.select(*columns)), slots


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, **options) -> DataFrame:
    """shard, slot, source, block, n_words, text: the output shards, each slot with the words of
    its block, set off by one blank. Write it partitioned or sorted by shard. Rows equal in id,
    text and source are packed once for each of them."""
    numbered, met, slots = _met(docs, id_col=id_col, text_col=text_col, source_col=source_col, block=block, **options)
    places = met.where("_times > 0").groupBy("_id", "_src", "_h").agg(F.collect_set(F.struct("_n", "_at", "size")).alias("_ats"))
    texts = docs.select(docs[id_col].alias("_did"), docs[source_col].alias("_dsrc"), docs[text_col].alias("_text"), F.xxhash64(docs[text_col]).alias("_key")).dropDuplicates(["_did", "_dsrc", "_key"])
    both = texts.join(places, F.col("_did").eqNullSafe(F.col("_id")) & F.col("_dsrc").eqNullSafe(F.col("_src")) & (F.col("_key") == F.col("_h")))
    words = both.select(F.explode("_ats").alias("x"), F.expr("regexp_extract_all(_text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)").alias("w")).select("x.*", "w")
    pieces = words.select("_n", "_at", "w", F.explode(F.expr(f"sequence(_at div {block}, (_at + size - 1) div {block})")).alias("_b")).select(
        "_n", "_b", "_at", F.expr(f"slice(w, cast(greatest(_b * {block} - _at, 0) + 1 AS INT), cast({block} - greatest(_at - _b * {block}, 0) AS INT))").alias("w"))
    blocks = pieces.groupBy("_n", "_b").agg(F.expr("flatten(transform(array_sort(collect_list(struct(_at, w))), x -> x.w))").alias("w"))
    names = numbered.select("_n", F.col("_src").alias("source")).distinct()
    packed = slots.withColumnRenamed("source", "_s").join(blocks, (F.col("_s") == F.col("_n")) & (F.col("block") == F.col("_b"))).drop("_n", "_b")
    return packed.join(F.broadcast(names), F.col("_s") == F.col("_n")).select("shard", "slot", "source", "block", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("text"))


def _ranges(met: DataFrame, block: int) -> DataFrame:
    """_id, _src, _h, _at, _size, _runs: the word ranges (copy, a, b) that the mix takes of each
    document, in words of the document from 0, end exclusive. A block's k-th taking belongs to
    copy k; ranges of a copy that touch are one."""
    pieces = (
        met.where("_times > 0").withColumn("a", F.col("_b") * block + F.col("_from") - F.col("_at")).withColumn("b", F.expr("a + _to - _from"))
        .select("_n", "_at", "_id", "_src", "_h", "size", "a", "b", F.explode(F.expr("sequence(1L, _times)")).alias("c"))
    )
    along = Window.partitionBy("_n", "_at").orderBy("c", "a")
    fresh = F.when((F.lag("c").over(along) == F.col("c")) & (F.lag("b").over(along) == F.col("a")), 0).otherwise(1)
    runs = pieces.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(along))
    whole = runs.groupBy("_n", "_at", "_run").agg(*[F.first(c).alias(c) for c in ("_id", "_src", "_h", "size", "c")], F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.groupBy("_n", "_at").agg(*[F.first(c).alias(c) for c in ("_id", "_src", "_h")], F.first("size").alias("_size"),
                                          F.sort_array(F.collect_list(F.struct("c", "a", "b"))).alias("_runs")).drop("_n")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, size, source_size, target, taken of every document (see ``mix``)."""
    rows, _ = mix(docs, id_col=id_col, **options)
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, block: int = BLOCK, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole copy, and for each run of words that
    stand together in the blocks drawn, with the text between them as it was. A document that
    isn't taken goes. ``length_col`` names a column that holds the texts' length and follows
    them. Rows equal in id, text and source get a place in the stream each."""
    _, met, _ = _met(docs, id_col=id_col, text_col=text_col, source_col=source_col, block=block, **options)
    equal = Window.partitionBy("_id", "_src", "_h").orderBy("_at")
    ranges = checkpoint(_ranges(met, block))
    places = checkpoint(met.groupBy("_id", "_src", "_h").agg(F.countDistinct("_at").alias("_rows")).where("_rows > 1"))
    # the other columns are packed, so that no column's name can clash
    rest = [c for c in docs.columns if c not in (text_col, length_col)]
    keyed = docs.select(F.struct(*[docs[c] for c in rest], F.lit(0).alias("_")).alias("_row"), docs[id_col].alias("_did"), docs[source_col].alias("_dsrc"), docs[text_col].alias("_text"), F.xxhash64(docs[text_col]).alias("_key"),
                        docs[length_col].alias("_length") if length_col else F.lit(None).cast("long").alias("_length"))
    same = F.col("_did").eqNullSafe(F.col("_id")) & F.col("_dsrc").eqNullSafe(F.col("_src")) & (F.col("_key") == F.col("_h"))
    alike = [ranges[c].eqNullSafe(places[c]) for c in ("_id", "_src", "_h")]
    if places.isEmpty():
        both = keyed.join(ranges, same)
    else:  # the k-th of equal rows gets the k-th place
        both = keyed.join(ranges.join(places, alike, "left_anti"), same)
        at = met.select("_id", "_src", "_h", "_at").distinct()
        at = at.join(places, [at[c].eqNullSafe(places[c]) for c in ("_id", "_src", "_h")], "left_semi").withColumn("_k", F.row_number().over(equal)).select("_at", "_k", F.col("_src").alias("_s"))
        many = ranges.join(places, alike, "left_semi").join(at.withColumnRenamed("_at", "_a"), (F.col("_at") == F.col("_a")) & F.col("_src").eqNullSafe(F.col("_s"))).drop("_a", "_s")
        order = F.xxhash64(*[F.col("_row")[c] for c, kind in docs.dtypes if c in rest and "map<" not in kind], F.lit(0))
        again = keyed.join(places, same, "left_semi").withColumn("_dk", F.row_number().over(Window.partitionBy("_did", "_dsrc", "_key").orderBy(order)))
        both = both.unionByName(again.join(many, same & (F.col("_dk") == F.col("_k"))).drop("_k", "_dk"))
    space = "\\\\x20\\\\x09-\\\\x0D"
    pieces = F.expr(f"""transform(
        IF(exists(_runs, r -> r.b - r.a < _size), array(regexp_extract_all(_text, '[{space}]*[^{space}]+', 0)), array(cast(array() AS ARRAY<STRING>))),
        w -> transform(_runs, r -> IF(r.b - r.a = _size, named_struct('t', _text, 'n', _length),
            transform(array(regexp_replace(array_join(slice(w, cast(r.a + 1 AS INT), cast(r.b - r.a AS INT)), ''), '^[{space}]+', '')), t -> named_struct('t', t, 'n', cast(length(t) AS BIGINT)))[0])))[0]""")
    out = both.select("_row", F.explode(pieces).alias("_new"))
    changed = {text_col: F.col("_new.t")}
    if length_col:
        changed[length_col] = F.col("_new.n")
    return out.select(*[changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"))
