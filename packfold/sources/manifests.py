"""Manifests (text files naming one data file per line) and file catalogues."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packfold.session import materialize
from packfold.sources.numbered import file_system

PREFIX = "list:"
# file:///a and file:/a are one file; which of the two is told depends on who tells it.
NO_HOST = "^([^:/]+):///"
GLOB = re.compile(r"[*?\[{]")
# Names listed before they are handed on, and files that a task looks up.
NAMES_AT_ONCE, FILES_OF_TASK = 10_000, 20_000


def is_manifest(fmt: str | None) -> bool:
    return bool(fmt) and fmt.startswith(PREFIX)


def manifest_format(fmt: str) -> str:
    """The format behind ``list:``; empty when none is given."""
    parts = fmt.split(":")
    if len(parts) != 2:
        raise ValueError(f"expected format list:<format>, found {fmt}")
    return parts[1].strip()


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a manifest, stripped."""
    stripped = F.btrim("value", F.lit(" \t\r\n")).alias("path")
    return spark.read.text(path).select(stripped).filter(F.col("path") != "")


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths of a manifest in file order. They name the inputs of a scan, so the driver
    needs them; the data they name stays on the executors."""
    try:
        return [row.path for row in manifest_lines(spark, path).collect()]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise


def load_file_list(spark: SparkSession, path: str, fmt: str) -> tuple[list[str], str] | None:
    """``(paths, format)`` of a ``list:<format>`` input; None for any other format."""
    if not is_manifest(fmt):
        return None
    inner = manifest_format(fmt)
    return read_manifest(spark, path), inner


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Files that an entry of a list stands for (itself, a folder's or a glob's), named as in
    Spark's file metadata."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(hadoop) or []:
        if not status.isDirectory():
            found.append(status.getPath())
            continue
        inner = system.listFiles(status.getPath(), True)
        while inner.hasNext():
            file = inner.next().getPath()
            below = status.getPath().toUri().relativize(file.toUri()).getPath()
            if not any(part[:1] in "_." for part in below.split("/")):
                found.append(file)
    if not found:
        raise FileNotFoundError(path)
    return [re.sub(NO_HOST, r"\1:/", file.toUri().toString()) for file in found]


def file_name() -> Column:
    """The file a row was read from, named as by ``files_of``."""
    return F.regexp_replace(F.col("_metadata.file_path"), NO_HOST, "$1:/")


def qualified(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths as Spark names files: with their file system, and from its root."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path("x")
    here = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()[: -len("/x")]
    root = re.match("^[^:/]+:(//[^/]+)?", here)[0]

    def whole(path: str) -> str:
        system = re.match("^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?", path)
        if system:
            return re.sub(NO_HOST, r"\1:/", system[0] + "/" + posixpath.normpath("/" + path[system.end() :]).lstrip("/"))
        return root + posixpath.normpath(path) if path.startswith("/") else root + posixpath.normpath(f"{here[len(root):]}/{path}")

    return [whole(path) for path in paths]


def manifest_table(spark: SparkSession, paths: Sequence[str], ordinal: str) -> DataFrame:
    """Files as Spark reports them in metadata: ``_file``, and the place in the list of each entry
    they belong to. Entries are files, folders with all below them, and globs.

    Spark lists files and folders, in parallel where there are many; only globs are looked up
    one by one. An entry that stands for no file raises FileNotFoundError.
    """
    plain = [(i, path) for i, path in enumerate(paths) if not GLOB.search(path)]
    located = [(file, i) for i, path in enumerate(paths) if GLOB.search(path) for file in files_of(spark, path)]
    by_glob = spark.createDataFrame(located, f"_file string, {ordinal} int")
    if not plain:
        return by_glob
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        listed = reader.load(list(dict.fromkeys(path for _, path in plain)))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(str(error)) from error
        raise
    named = listed.select(F.regexp_replace("path", NO_HOST, "$1:/").alias("_path"), file_name().alias("_file"))
    parts = F.split("_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    places = list(zip([i for i, _ in plain], qualified(spark, [path for _, path in plain])))
    entries = spark.createDataFrame(places, f"{ordinal} int, _entry string")
    files = materialize(named.distinct().select("_file", F.explode(above).alias("_entry")).join(entries, "_entry"), "listed-files")
    files = files.select("_file", ordinal)
    missing = entries.join(files.select(ordinal).distinct(), ordinal, "left_anti").first()
    if missing is not None:
        raise FileNotFoundError(missing["_entry"])
    return files.union(by_glob) if located else files


def catalogue(
    spark: SparkSession, root: str, *, fmt: str = "parquet", prefix: str | None = None, recursive: bool = False
) -> DataFrame:
    """Files below ``root`` ending in ``.fmt``: path, size and time. File contents are not read."""
    start = f"{root.rstrip('/')}/{prefix}" if prefix else root
    if recursive and not GLOB.search(fmt) and (folder := _reached_folder(spark, start)):
        return _listed_below(spark, folder, f".{fmt}")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(start).select("path", "length", "modificationTime")


def _reached_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as Spark names it, if it is a folder that tasks can list by themselves."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if GLOB.search(path) or not (system.exists(hadoop) and system.getFileStatus(hadoop).isDirectory()):
        return None
    (folder,) = qualified(spark, [path])
    try:
        file_system(folder)
    except Exception:  # a file system that only Spark knows
        return None
    return folder


def _shown(name: str) -> bool:
    """Whether Spark's own listing shows files and folders of this name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return True
    return not (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_"))


def _listed_below(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """The catalogue of all folders below ``root``: one task lists names, folder by folder, and tasks
    look up the files that are dealt to them. A file without bytes has no row, as in Spark's own scan."""

    def listed(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        for _ in batches:
            pass
        system, path = file_system(root)

        def inside(folder):
            if system.type_name == "local":
                with os.scandir(folder) as entries:
                    yield from ((entry.name, entry.is_dir()) for entry in entries)
            else:
                for info in system.get_file_info(fs.FileSelector(folder)):
                    yield info.base_name, info.type == fs.FileType.Directory

        folders, names = [""], []
        while folders:
            below = folders.pop()
            for name, is_folder in inside(f"{path}/{below}"):
                if is_folder and _shown(name):
                    folders.append(f"{below}{name}/")
                elif name.endswith(ending) and _shown(name):
                    names.append(below + name)
                if len(names) == NAMES_AT_ONCE:
                    yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string())})
                    names = []
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string())})

    def looked_up(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, path = file_system(root)
        for batch in batches:
            names = batch.column("file").to_pylist()
            found = [(name, info) for name, info in zip(names, system.get_file_info([f"{path}/{name}" for name in names])) if info.type == fs.FileType.File and info.size]
            yield pa.RecordBatch.from_pydict(
                {
                    "path": pa.array([f"{root}/{name}" for name, _ in found], pa.string()),
                    "length": pa.array([info.size for _, info in found], pa.int64()),
                    "millis": pa.array([info.mtime_ns // 1_000_000 for _, info in found], pa.int64()),
                }
            )

    names = materialize(spark.range(1).coalesce(1).mapInArrow(listed, "file string"), "file-names")
    tasks = max(spark.sparkContext.defaultParallelism, names.count() // FILES_OF_TASK + 1)
    found = names.repartition(tasks).mapInArrow(looked_up, "path string, length long, millis long")
    return found.select("path", "length", F.timestamp_millis("millis").alias("modificationTime"))
