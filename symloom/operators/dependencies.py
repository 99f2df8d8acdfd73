"""Packages that a workspace depends on: found, resolved, queued, and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directories in which package managers put the code of others, and whose they are.
ECOSYSTEM_OF = {
    "vendor": "go", "Godeps": "go", "node_modules": "npm", "bower_components": "bower", "site-packages": "python", "third_party": "bundled", "third-party": "bundled",
}
_DIR = r"(?:^|/)(" + "|".join(ECOSYSTEM_OF) + r")/(?:_workspace/src/)?([^/]+)/"


def is_dependency(path: Column) -> Column:
    return F.coalesce(path.rlike(_DIR), F.lit(False))


def package_files(files: DataFrame) -> DataFrame:
    """(file_id, worktree_key, ecosystem, package) of the files of dependencies."""
    inside = files.where(is_dependency(F.col("rel_path")))
    ecosystem = F.create_map(*[F.lit(x) for pair in ECOSYSTEM_OF.items() for x in pair])[F.regexp_extract("rel_path", _DIR, 1)]
    return inside.select("file_id", "worktree_key", ecosystem.alias("ecosystem"), F.regexp_extract("rel_path", _DIR, 2).alias("package"))


def detect(files: DataFrame) -> DataFrame:
    """(worktree_key, ecosystem, package, files): the packages whose code lies in each worktree."""
    return package_files(files).groupBy("worktree_key", "ecosystem", "package").agg(F.count_distinct("file_id").alias("files"))


def lock_packages(locks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, version) of each package of lock files in which a package is a `[[package]]` table of `name = "..."` and
    `version = "..."`, in any order and among other fields. Blocks that lack one of them, and null texts, have none."""
    blocks = locks.select(key, F.explode(F.split(F.col(text), r"(?m)^\[\[package\]\]\s*$")).alias("_b"))
    field = lambda name: F.regexp_extract("_b", rf'(?m)^{name}\s*=\s*"([^"]*)"', 1)
    return blocks.select(key, field("name").alias("name"), field("version").alias("version")).where((F.col("name") != "") & (F.col("version") != ""))


def resolve(locked: DataFrame, directories: DataFrame) -> DataFrame:
    """(key columns, name, version, path): where locked packages lie. A directory is named like the package, with or
    without `-` and its version, as registries do; a package without one is left out."""
    last = F.element_at(F.split("path", "/"), -1)
    named = directories.select("path", last.alias("_dir"))
    exact = locked.join(named, F.concat_ws("-", "name", "version") == F.col("_dir"))
    plain = locked.join(named, F.col("name") == F.col("_dir"))
    return exact.unionByName(plain).drop("_dir").distinct()


def pending(packages: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """Packages that still have to be indexed, each once."""
    return packages.dropDuplicates(keys).join(indexed.select(*keys).distinct(), keys, "left_anti")


def counts(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """(packages, files, definitions) of the dependency index: one row, zeros if there is none."""
    deps = package_files(files).dropDuplicates(["file_id"])
    per_file = definitions.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    per_package = deps.join(per_file, "file_id", "left").groupBy("ecosystem", "package").agg(F.count(F.lit(1)).alias("f"), F.coalesce(F.sum("n"), F.lit(0)).alias("d"))
    return per_package.agg(F.count(F.lit(1)).alias("packages"), F.coalesce(F.sum("f"), F.lit(0)).alias("files"), F.coalesce(F.sum("d"), F.lit(0)).alias("definitions"))
