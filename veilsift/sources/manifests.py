"""Dependency manifests: two name -> version maps per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_at_version
from ..schemas import MANIFEST


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest JSON files; ``manifest_id`` is the file they come from."""
    return (
        spark.read.schema(MANIFEST).option("multiLine", True).json(path)
        .select(
            F.col("_metadata.file_path").alias("manifest_id"),
            "name", "dependencies", "devDependencies",
        )
    )


def merged_dependencies(runtime: Column, dev: Column) -> Column:
    """Both maps as ``array<(name, version, is_dev)>``.

    A development version wins over a runtime one of the same name and keeps its
    place. Row-local, and independent of the session's duplicate-key policy.
    """
    empty = F.create_map().cast("map<string,string>")
    runtime, dev = F.coalesce(runtime, empty), F.coalesce(dev, empty)

    def entry(name: Column, version: Column, is_dev: Column) -> Column:
        return F.struct(name.alias("name"), version.alias("version"), is_dev.alias("is_dev"))

    first = F.transform(F.map_entries(runtime), lambda e: entry(
        e.key,
        F.when(F.map_contains_key(dev, e.key), F.element_at(dev, e.key)).otherwise(e.value),
        F.map_contains_key(dev, e.key),
    ))
    rest = F.transform(
        F.filter(F.map_entries(dev), lambda e: ~F.map_contains_key(runtime, e.key)),
        lambda e: entry(e.key, e.value, F.lit(True)),
    )
    return F.concat(first, rest)


def manifest_dependencies(manifests: DataFrame) -> DataFrame:
    """One row per dependency, ``ordinal`` counting from 0 within a manifest."""
    return manifests.select(
        "manifest_id",
        F.posexplode(merged_dependencies(F.col("dependencies"), F.col("devDependencies")))
        .alias("ordinal", "_d"),
    ).select("manifest_id", "ordinal", "_d.*")


def dependency_lists(manifests: DataFrame) -> DataFrame:
    """``name@version`` lines per manifest and their number; 0 marks an empty manifest."""
    merged = merged_dependencies(F.col("dependencies"), F.col("devDependencies"))
    return manifests.withColumn("_m", merged).select(
        "manifest_id",
        F.size("_m").alias("n_dependencies"),
        F.array_join(
            F.transform(F.col("_m"), lambda d: name_at_version(d["name"], d["version"])), "\n"
        ).alias("dependency_list"),
    )
