"""Files to entity and relation rows: one outline per file, in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocab as V
from tessera.operators import modules
from tessera.runtime import checkpoint, ship_package

_ALL = ", ".join(["tag string", *(f"e_{x}" for x in V.ENTITY_SCHEMA.split(", ")), *(f"r_{x}" for x in V.RELATION_SCHEMA.split(", ")), "q_path string, q_defects int, q_first_defect int"])


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def outlines(discovered: DataFrame) -> DataFrame:
    """Tagged rows (entity, relation, quality) of every Rust file; other languages have no
    rules and give a file entity alone."""
    ship_package(discovered.sparkSession)
    names = [x.split()[0] for x in _ALL.split(", ")]

    def run(frames):
        import pandas as pd

        from tessera.sources.rust import Outline, outline

        for frame in frames:
            rows = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"]):
                if language == "rust":
                    ents, rels, quality = outline(path, text)
                else:
                    ents, rels, quality = Outline(path, "").entities, [], {"path": path, "defects": 0, "first_defect": None}
                    ents[0]["language"] = language
                rows += [{"tag": "entity", **{f"e_{k}": v for k, v in e.items()}} for e in ents]
                rows += [{"tag": "relation", **{f"r_{k}": v for k, v in r.items()}} for r in rels]
                rows.append({"tag": "quality", **{f"q_{k}": v for k, v in quality.items()}})
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.where(out.notna(), None)

    return discovered.select("path", "language", "text").mapInPandas(run, _ALL)


def extract(discovered: DataFrame, all_paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, quality) of a file table, with module and package rows of the
    paths (``all_paths``: what decides the packages, the same files unless given)."""
    rows = checkpoint(outlines(discovered))
    e = rows.where("tag = 'entity'").select(*[F.col(f"e_{n}").alias(n) for n in _names(V.ENTITY_SCHEMA)])
    r = rows.where("tag = 'relation'").select(*[F.col(f"r_{n}").alias(n) for n in _names(V.RELATION_SCHEMA)])
    q = rows.where("tag = 'quality'").select(F.col("q_path").alias("path"), F.col("q_defects").alias("defects"), F.col("q_first_defect").alias("first_defect"))
    located = modules.locate((all_paths or discovered.where("language = 'rust'").select("path")).distinct())
    me, mr = modules.module_entities(located)
    own = discovered.select("path").distinct()
    # edges of the files read, into modules of any file of the layout
    every = me
    me = me.join(own, "path", "left_semi")
    mr = mr.join(own.withColumnRenamed("path", "source_path"), "source_path", "left_semi").join(every.select(F.col("path").alias("target_path"), F.col("qualified_name").alias("target_qualified_name")).distinct(), ["target_path", "target_qualified_name"], "left_semi")
    columns, rcolumns = _names(V.ENTITY_SCHEMA), _names(V.RELATION_SCHEMA)
    return e.unionByName(me.select(*columns)), r.unionByName(mr.select(*rcolumns)), q


def counts_by_file(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(path, what, kind, n)"""
    a = entities.groupBy("path", "kind").agg(F.count("*").alias("n")).select("path", F.lit("entity").alias("what"), "kind", "n")
    b = relations.groupBy(F.col("source_path").alias("path"), "kind").agg(F.count("*").alias("n")).select("path", F.lit("relation").alias("what"), "kind", "n")
    return a.unionByName(b)
