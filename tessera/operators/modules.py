"""Packages and modules from the set of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs as X

SOURCE_ROOTS = ("src",)
ROOT_FILES = ("lib", "main")


def package_roots(paths: DataFrame) -> DataFrame:
    """(root): directories that hold a lib or main file, without the source folder at their
    end; a root right below another root's source folder is none."""
    stem = F.regexp_extract(X.file_name("path"), r"^([^.]+)\.[^.]+$", 1)
    holders = paths.where(stem.isin(*ROOT_FILES)).select(F.coalesce(X.parent("path"), F.lit("")).alias("dir"))
    roots = holders.select(F.regexp_replace("dir", r"(^|/)src$", "").alias("root")).distinct()
    above = F.regexp_replace(F.col("root"), r"(^|/)[^/]*$", "")
    inside = roots.where(F.col("root").contains("/")).select(F.col("root").alias("_root"), above.alias("up")).where("up RLIKE '(^|/)src$'").select("_root", F.regexp_replace("up", r"(^|/)src$", "").alias("outer"))
    nested = inside.join(roots, F.col("outer") == F.col("root"), "left_semi").select(F.col("_root").alias("root"))
    return roots.join(nested, "root", "left_anti")


def needs_roots(path) -> F.Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in SOURCE_ROOTS]))


def locate(paths: DataFrame) -> DataFrame:
    """path -> package, package root and ``::`` path of its module: below the first source
    folder, else below the deepest package root that holds the path, else below the root."""
    parts = F.split("path", "/")
    at = F.array_position(parts, "src").cast("int")
    by_src = paths.where(at > 0).select("path", F.array_join(F.slice(parts, F.lit(1), at - 1), "/").alias("root"), F.array_join(F.slice(parts, at + 1, F.size(parts)), "/").alias("rest"))
    other = paths.where(at == 0)
    roots = package_roots(paths).where("root NOT RLIKE '(^|/)src(/|$)'")
    ups = other.select("path", F.explode(F.expr("transform(sequence(0, size(split(path, '/')) - 1), k -> array_join(slice(split(path, '/'), 1, k), '/'))")).alias("root"))
    deepest = ups.join(roots, "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    rest = other.join(deepest, "path", "left").select("path", F.coalesce("root", F.lit("")).alias("root")).withColumn("rest", F.expr("IF(root = '', path, substr(path, length(root) + 2))"))
    both = by_src.unionByName(rest)
    stem = F.regexp_replace("rest", r"\.[^./]+$", "")
    module = F.when(stem.isin(*ROOT_FILES), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(stem, "/mod$", ""), "/", "::"))
    name = F.regexp_replace(F.when(F.col("root") == "", F.lit("crate")).otherwise(X.file_name("root")), "-", "_")
    return both.select("path", name.alias("package"), F.col("root").alias("package_root"), F.when(module == "mod", F.lit("")).otherwise(module).alias("module"))


def module_entities(located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Module and package entities, and the contains edges file -> module, package -> module.
    A module belongs to the file that spells it first."""
    from tessera.functions import vocab as V

    full = F.concat_ws("::", "package", F.when(F.col("module") != "", F.col("module")))
    m = located.withColumn("qn", full).withColumn("kind", F.lit("module"))
    p = located.groupBy("package").agg(F.min("path").alias("path")).withColumn("qn", F.col("package")).withColumn("kind", F.lit("package"))
    both = m.select("path", "kind", "qn").unionByName(p.select("path", "kind", "qn"))
    ent = both.select("path", "kind", X.kind_ord("kind").alias("kind_ord"), F.col("qn").alias("qualified_name"), F.lit(0).alias("entity_ordinal"), F.element_at(F.split("qn", "::"), -1).alias("name"),
                      *[F.lit(None).cast(t).alias(c) for c, t in _rest(V.ENTITY_SCHEMA, 6)])
    ent = ent.withColumn("is_test", F.lit(False)).withColumn("structural_fingerprint", X.fingerprint("qualified_name"))
    names = [x.split()[0] for x in V.ENTITY_SCHEMA.split(", ")]
    edge = m.select(F.lit("contains").alias("kind"), F.col("path").alias("source_path"), F.lit("file").alias("source_kind"), X.file_name("path").alias("source_qualified_name"), F.col("path").alias("target_path"), F.col("qn").alias("q"))
    pk = p.select(F.col("package"), F.col("path").alias("pp"))
    edge2 = m.join(pk, "package").select(F.lit("contains").alias("kind"), F.col("pp").alias("source_path"), F.lit("package").alias("source_kind"), F.col("package").alias("source_qualified_name"), F.col("path").alias("target_path"), F.col("qn").alias("q"))
    rel = edge.unionByName(edge2)
    rnames = [x.split()[0] for x in V.RELATION_SCHEMA.split(", ")]
    have = {"source_ordinal": F.lit(0), "target_name": F.col("q"), "target_kind": F.lit("module"), "target_qualified_name": F.col("q"), "target_ordinal": F.lit(0), "start_byte": F.lit(0), "end_byte": F.lit(0),
            "start_line": F.lit(1), "start_column": F.lit(1), "end_line": F.lit(1), "end_column": F.lit(1), "resolution_state": F.lit("resolved"), "ev_class": F.lit("containment")}
    types = dict(x.split() for x in V.RELATION_SCHEMA.split(", "))
    rel = rel.select(*[(F.col(c) if c in rel.columns else have.get(c, F.lit(None))).cast(types[c]).alias(c) for c in rnames])
    return ent.select(*names), rel


def _rest(schema: str, skip: int) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(", ")[skip:]]
