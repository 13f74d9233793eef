"""Few files per partition for the stores that streams append to (K2, K3).

A micro-batch leaves a file per partition and task, so an hour's folder fills
with small files. They can't be rewritten in place: the file sink's commit log
names them, and a reader would see rows twice or not at all. A compaction
therefore writes new files beside the store and then a manifest: which of the
store's files they replace, and which compacted files count. A reader takes the
newest complete manifest, the files it names and the store's files that it
doesn't replace, so at any moment each committed row is read once. Readers that
planned before go on with the files they have; nothing they need is removed.

The rewrite is a Spark job over the partitions that gained files, its tasks
sized by bytes; what the driver holds is file names, as Spark's file index does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from cabline.schema import PARTITION_COLUMNS
from cabline.session import child_names, path_exists, remove_path

MANIFEST = "replaced boolean, path string"


def _partition(path: str, columns: tuple[str, ...]) -> str:
    """``year=2023/month=1`` of a file below it."""
    return "/".join(p for p in path.split("/") if p.split("=")[0] in columns)


def _versions(spark: SparkSession, out: str) -> list[int]:
    root = f"{out}/manifests"
    return sorted(int(n) for n in child_names(spark, root) if n.isdigit() and path_exists(spark, f"{root}/{n}/_SUCCESS"))


def _manifest(spark: SparkSession, out: str, version: int | None) -> tuple[set[str], set[str]]:
    """Files of the store that are replaced, and compacted files that count."""
    if version is None:
        return set(), set()
    rows = spark.read.schema(MANIFEST).parquet(f"{out}/manifests/{version}").collect()
    return {r.path for r in rows if r.replaced}, {r.path for r in rows if not r.replaced}


def _frames(spark: SparkSession, store: DataFrame, path: str, out: str, small: set[str], compacted: set[str]) -> DataFrame:
    reader = spark.read.schema(store.schema)
    parts = []
    if small:
        parts.append(reader.option("basePath", path).parquet(*sorted(small)))
    if compacted:
        parts.append(reader.option("basePath", f"{out}/data").parquet(*sorted(compacted)).select(*store.columns))
    return reduce(DataFrame.unionByName, parts) if parts else store.limit(0)


def compact(spark: SparkSession, path: str, out: str, partition_cols: tuple[str, ...] = PARTITION_COLUMNS, min_files: int = 2) -> int:
    """Rewrite the partitions of the store at ``path`` that have ``min_files``
    files or more, some of them new since the last compaction, into ``out``
    (not below ``path``). Returns how many partitions. One at a time per store;
    one that is cut off leaves no manifest and changes nothing."""
    path, out = path.rstrip("/"), out.rstrip("/")
    versions = _versions(spark, out)
    replaced, compacted = _manifest(spark, out, versions[-1] if versions else None)
    store = spark.read.parquet(path)
    new = set(store.inputFiles()) - replaced
    files: dict[str, list[str]] = {}
    for f in new | compacted:
        files.setdefault(_partition(f, partition_cols), []).append(f)
    chosen = {p for p, fs in files.items() if len(fs) >= min_files and not new.isdisjoint(fs)}
    if not chosen:
        return 0
    small = {f for f in new if _partition(f, partition_cols) in chosen}
    old = {f for f in compacted if _partition(f, partition_cols) in chosen}
    version = (versions[-1] if versions else 0) + 1
    target = f"{out}/data/version={version}"
    remove_path(spark, target)  # of a compaction that was cut off
    rows = _frames(spark, store, path, out, small, old).hint("rebalance", *partition_cols)
    rows.write.partitionBy(*partition_cols).parquet(target)
    written = set(spark.read.schema(store.schema).parquet(target).inputFiles())
    manifest = [(True, f) for f in replaced | small] + [(False, f) for f in (compacted - old) | written]
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifests/{version}")
    return len(chosen)


def read_compacted(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The whole store, each committed row once, from as few files as there are."""
    path, out = path.rstrip("/"), out.rstrip("/")
    # the manifest first: files that the sink commits after it are in no manifest, so they are read from the store
    versions = _versions(spark, out)
    replaced, compacted = _manifest(spark, out, versions[-1] if versions else None)
    store = spark.read.parquet(path)
    return _frames(spark, store, path, out, set(store.inputFiles()) - replaced, compacted)
