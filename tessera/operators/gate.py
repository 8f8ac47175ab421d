"""Measurement: bag matches, exact fractions, floors, negative controls and two-arm transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X

#: Keywords of the expectation corpus and the number of their fields.
KEYWORDS = {
    "symbol": 3, "member": 3, "call": 4, "import": 4, "import_no_module": 2, "reference": 3, "no_reference": 3, "inherits": 3, "implements": 3, "no_inherits": 3,
    "binds": 8, "binds_nothing": 5, "callers": 6, "callees": 6, "implementations": 6, "context": 4, "context_ambiguous": 1, "floor": 2,
}


def bag_match(labelled: DataFrame, found: DataFrame) -> DataFrame:
    """(hits, labelled, found) of two bags with the same columns: hits sum the smaller counts."""
    keys = labelled.columns
    a = labelled.groupBy(*keys).agg(F.count("*").alias("_a"))
    b = found.groupBy(*keys).agg(F.count("*").alias("_b"))
    both = a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "full_outer")
    z = F.lit(0)
    return both.agg(F.coalesce(F.sum(F.least(F.coalesce("_a", z), F.coalesce("_b", z))), z).cast("long").alias("hits"), F.coalesce(F.sum("_a"), z).cast("long").alias("labelled"),
                    F.coalesce(F.sum("_b"), z).cast("long").alias("found"))


def precision_recall(match: DataFrame) -> DataFrame:
    """Both fractions as numerator and denominator, and in hundredths of a percent."""
    return match.select(F.col("hits").alias("precision_n"), F.col("found").alias("precision_d"), F.col("hits").alias("recall_n"), F.col("labelled").alias("recall_d"),
                        X.hundredths("hits", "found").alias("precision"), X.hundredths("hits", "labelled").alias("recall"))


def check_floors(scores: DataFrame, floors: DataFrame) -> DataFrame:
    """(dimension, n, d) against (dimension, floor): a missing score misses its floor."""
    return floors.join(scores, "dimension", "left").select("dimension", "floor", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(0)).alias("d"),
                                                             F.coalesce(X.meets_floor("n", "d", "floor"), F.lit(False)).alias("meets"))


def violations(negative: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(labelled, violations): things labelled as absent that were found."""
    hit = negative.join(found.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("violations"), F.lit(1).alias("_one"))
    return negative.agg(F.count("*").alias("labelled"), F.lit(1).alias("_one")).join(hit, "_one").drop("_one")


def placement(labels: DataFrame, relations: DataFrame, site: list[str], target: str = "target") -> DataFrame:
    """Each labelled site is correct, wrong, undecided or without a relation: counts."""
    got = labels.withColumnRenamed(target, "_want").join(relations.select(*site, F.col(target).alias("_got"), "state"), site, "left")
    one = got.groupBy(*site, "_want").agg(F.max(F.col("_got").eqNullSafe(F.col("_want")).cast("int")).alias("ok"), F.max(F.col("state").isin("resolved", "inferred").cast("int")).alias("decided"), F.count("state").alias("n"))
    verdict = F.when(F.col("n") == 0, "no_relation").when((F.col("ok") == 1) & (F.col("decided") == 1), "correct").when(F.col("decided") == 1, "wrong").otherwise("undecided")
    return one.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def price_rule(base: DataFrame, variant: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """(repairs, damage): labelled edges that only the variant, or only the base, gets right."""
    j = labels.join(base.select(*key, F.col("target").alias("_b")), key, "left").join(variant.select(*key, F.col("target").alias("_v")), key, "left")
    right_b, right_v = F.col("_b").eqNullSafe(F.col("target")), F.col("_v").eqNullSafe(F.col("target"))
    return j.agg(F.count(F.when(right_v & ~right_b, 1)).alias("repairs"), F.count(F.when(right_b & ~right_v, 1)).alias("damage"))


def transitions(off: DataFrame, on: DataFrame, key: list[str]) -> DataFrame:
    """(bucket, n): how each relation moved between two arms (state, ev_class, target)."""
    a = off.select(*key, F.col("state").alias("s0"), F.col("ev_class").alias("e0"), F.col("target").alias("t0"))
    b = on.select(*key, F.col("state").alias("s1"), F.col("ev_class").alias("e1"), F.col("target").alias("t1"))
    j = a.join(b, key, "full_outer")
    s0, s1 = F.col("s0"), F.col("s1")
    bucket = (
        F.when(s0.isNull(), "only on").when(s1.isNull(), "only off")
        .when(s0.eqNullSafe(s1) & F.col("t0").eqNullSafe(F.col("t1")) & F.col("e0").eqNullSafe(F.col("e1")), "unchanged")
        .when((s0 != "resolved") & (s1 == "resolved"), "gained a proof").when((s0 == "resolved") & (s1 != "resolved"), "lost its proof")
        .when((s0 == "resolved") & (s1 == "resolved"), "proof rerouted").when((s0 == "inferred") & (s1 == "inferred"), "claim rerouted")
        .when(s1 == "inferred", "nothing gained but a claim").otherwise("moved among the undecided")
    )
    return j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def expectations(spark, path: str) -> DataFrame:
    """(line, keyword, f): a label corpus of ``keyword | field | ...`` lines; ``#`` starts a
    comment and ``-`` is an absent field. Unknown keywords or too few fields raise."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "t"))
    rows = raw.withColumn("t", F.trim("t")).where((F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    parts = F.transform(F.split("t", r"\|"), lambda x: F.trim(x))
    out = rows.select((F.col("line") + 1).alias("line"), parts[0].alias("keyword"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.when(x != "-", x)).alias("f"))
    need = F.lit(None).cast("int")
    for k, n in KEYWORDS.items():
        need = F.when(F.col("keyword") == k, n).otherwise(need)
    bad = out.where(need.isNull() | (F.size("f") < need)).first()
    if bad is not None:
        raise ValueError(f"line {bad['line']}: {bad['keyword']!r} with {len(bad['f'])} fields")
    return out


def score_corpus(expect: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(dimension, n, d) of the labelled dimensions over one index."""
    f = lambda k: expect.where(F.col("keyword") == k).select("f")
    e, r = entities, relations
    want = f("symbol").select(F.col("f")[0].alias("path"), F.col("f")[1].alias("kind"), F.col("f")[2].alias("q"))
    have = e.where(~F.col("kind").isin("file", "package") & ~((F.col("kind") == "module") & F.col("start_byte").isNull())).select("path", "kind", F.col("qualified_name").alias("q"))
    out = []

    def add(name, match, of):
        out.append(match.select(F.lit(name).alias("dimension"), F.col("hits").alias("n"), F.col(of).alias("d")))

    m = bag_match(want, have)
    add("symbol_precision", m, "found")
    add("symbol_recall", m, "labelled")
    calls = r.where("kind = 'calls'")
    add("calls", bag_match(f("call").select(F.col("f")[0].alias("p"), F.col("f")[1].alias("k"), F.col("f")[2].alias("q"), F.col("f")[3].alias("n")), calls.selectExpr("source_path AS p", "source_kind AS k", "source_qualified_name AS q", "target_name AS n")), "labelled")
    refs = r.where("kind = 'references'").selectExpr("source_path AS p", "source_qualified_name AS q", "target_name AS n").distinct()
    add("references", bag_match(f("reference").select(F.col("f")[0].alias("p"), F.col("f")[1].alias("q"), F.col("f")[2].alias("n")), refs), "labelled")
    imports = r.where("kind = 'imports'").selectExpr("source_path AS p", "target_name AS n").distinct()
    add("imports", bag_match(f("import").select(F.col("f")[0].alias("p"), F.col("f")[1].alias("n")).distinct(), imports), "labelled")
    inside = r.where("kind IN ('contains', 'owns')").selectExpr("target_path AS p", "source_qualified_name AS o", "target_qualified_name AS m").distinct()
    add("members", bag_match(f("member").select(F.col("f")[0].alias("p"), F.col("f")[1].alias("o"), F.col("f")[2].alias("m")), inside), "labelled")
    for k, kind in (("inherits", "inherits"), ("implements", "implements")):
        got = r.where(F.col("kind") == kind).selectExpr("source_path AS p", "source_qualified_name AS q", "target_name AS n").distinct()
        add(k, bag_match(f(k).select(F.col("f")[0].alias("p"), F.col("f")[1].alias("q"), F.col("f")[2].alias("n")), got), "labelled")
    res = out[0]
    for x in out[1:]:
        res = res.unionByName(x)
    return res


def per_repository(relations: DataFrame, repo: str = "repo") -> DataFrame:
    """Invariants by repository: the states add up, nothing is pending."""
    from tessera.functions import vocab as V

    c = relations.groupBy(repo).agg(F.count("*").alias("relations"), *[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in V.STATES])
    return c.withColumn("partitioned", F.expr(" + ".join(f"`{s}`" for s in V.STATES)) == F.col("relations")).withColumn("settled", F.col("pending") == 0)
