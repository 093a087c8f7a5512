"""Project directories as a file table.

Spark's file listing hides names that start with a dot, so ``.env`` would be lost; the
tree is walked inside tasks instead, a folder per row and a level per job. Listing and reading
are separate steps: sizes and links are judged before any content is read, and reading is
spread by file, not by project. Roots are local or mounted paths, or URIs of any file system
that Arrow knows; the latter have no links.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quietkey.operators.ignore import DEFAULT_IGNORE_FILE
from quietkey.operators.limits import MAX_FILE_BYTES
from quietkey.operators.ordering import durable
from quietkey.operators.paths import (
    SKIPPED_DIRECTORIES,
    is_artifact_file,
    is_artifact_path,
    is_dotenv_file,
    is_supported_file,
)

_MANIFEST = (
    "project_id string, root string, path string, length bigint, is_symlink boolean, "
    "readable boolean, is_directory boolean"
)
_FILES = (
    "project_id string, path string, length bigint, is_symlink boolean, readable boolean, "
    "content binary"
)


#: Rows that a task holds while it lists one folder.
_LISTED_ROWS = 10_000


def _system(root: str) -> tuple[fs.FileSystem, str] | None:
    """File system and path of a root given as a URI; None for a plain path."""
    return fs.FileSystem.from_uri(root) if "://" in root else None


def _local_entries(root: str, folder: str) -> Iterator[tuple]:
    """``(name, length, is_symlink, readable, is_directory)``; a link is described, never followed."""
    try:
        names = os.scandir(os.path.join(root, folder))
    except OSError:
        return
    with names:
        for entry in names:
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError:
                yield entry.name, None, False, False, False
                continue
            link = stat.S_ISLNK(info.st_mode)
            readable = os.path.isfile(entry.path) if link else stat.S_ISREG(info.st_mode)
            yield entry.name, info.st_size, link, readable, stat.S_ISDIR(info.st_mode)


def _remote_entries(root: str, folder: str) -> Iterator[tuple]:
    system, base = _system(root)
    for info in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}".rstrip("/"), allow_not_found=True)):
        directory = info.type == fs.FileType.Directory
        yield info.base_name, info.size or 0, False, info.type == fs.FileType.File, directory


def _children(project: str, root: str, path: str) -> Iterator[tuple]:
    entries = _remote_entries if _system(root) else _local_entries
    for name, length, link, readable, directory in entries(root, path):
        inside = f"{path}/{name}" if path else name
        # Dependency folders belong to nothing but a build output.
        built = inside.startswith(("dist/", "build/", ".next/static/"))
        if directory and (built or name not in SKIPPED_DIRECTORIES) or link or readable or length is None:
            yield project, root, inside, length, link, readable, directory


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of every folder, none of what is below them."""
    columns = [c.split()[0] for c in _MANIFEST.split(", ")]
    found: list[tuple] = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            for entry in _children(row.project_id, row.root, row.path):
                found.append(entry)
                if len(found) >= _LISTED_ROWS:
                    yield pd.DataFrame(found, columns=columns).astype({"length": "Int64"})
                    found = []
    yield pd.DataFrame(found, columns=columns).astype({"length": "Int64"})


def list_projects(roots: DataFrame, spread: int = 200) -> DataFrame:
    """Manifest of ``roots(project_id, root)`` without content.

    Folders are a queue: every job lists those that the one before found, each as a row of its
    own, dealt to ``spread`` tasks. So no task walks a subtree, however deep or wide, and
    there are as many jobs as levels. What is listed is stored, paths only.
    """
    folders = roots.select(F.col("project_id").cast("string").alias("project_id"), "root", F.lit("").alias("path"))
    found = None
    while found is None or not folders.isEmpty():
        level = folders.repartition(spread, "project_id", "path").mapInPandas(_list_folders, _MANIFEST)
        level = durable(level)
        files = level.where(~F.col("is_directory")).drop("is_directory")
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_directory").select("project_id", "root", "path")
    return found


def _content(root: str, path: str) -> bytes | None:
    """A file's bytes up to one past the limit, which shows a file that grew; None if it can't be read."""
    try:
        if remote := _system(root):
            with remote[0].open_input_stream(f"{remote[1].rstrip('/')}/{path}") as source:
                return source.read(MAX_FILE_BYTES + 1)
        with open(os.path.join(root, path), "rb") as source:
            return source.read(MAX_FILE_BYTES + 1)
    except OSError:
        return None


def _filled(row) -> tuple:
    """A file row of a manifest row, with its content if it may be read."""
    content, readable = None, row.readable
    if readable and not row.is_symlink and pd.notna(row.length) and row.length <= MAX_FILE_BYTES:
        content = _content(row.root, row.path)
        readable = content is not None
    return (row.project_id, row.path, row.length, row.is_symlink, readable, content)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _FILES.split(", ")]
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield pd.DataFrame([_filled(row)], columns=columns).astype({"length": "Int64"})


def _wanted(ignore_file: str) -> Column:
    path = F.col("path")
    return is_supported_file(path) | (is_artifact_path(path) & is_artifact_file(path)) | (path == ignore_file)


def read_files(manifest: DataFrame, spread: int = 200, ignore_file: str = DEFAULT_IGNORE_FILE) -> DataFrame:
    """Files of a manifest with bounded content, for those a scan can use."""
    return (
        manifest.where(_wanted(ignore_file))
        .repartition(spread, "project_id", "path")
        .mapInPandas(_read, _FILES)
    )


def file_kind(path: Column, ignore_file: str = DEFAULT_IGNORE_FILE) -> Column:
    """Partition value of a stored file table: the scan reads dotenv and artifact rows apart."""
    return (
        F.when(path == ignore_file, F.lit("rules"))
        .when(is_dotenv_file(path), F.lit("dotenv"))
        .when(is_artifact_path(path), F.lit("artifact"))
        .otherwise(F.lit("source"))
    )


def write_files(files: DataFrame, path: str) -> None:
    """Store a file table partitioned by kind, so that each part of a scan reads its own."""
    kinds = files.withColumn("kind", file_kind(F.col("path")))
    kinds.write.mode("errorifexists").partitionBy("kind").parquet(path)


def write_manifest(manifest: DataFrame, path: str, parts: int = 200, ignore_file: str = DEFAULT_IGNORE_FILE) -> None:
    """Store the files of a manifest that a scan can use, with their kind, for ``files_table``."""
    kinds = manifest.where(_wanted(ignore_file)).withColumn("kind", file_kind(F.col("path"), ignore_file))
    kinds.repartition(parts, "project_id", "path").write.mode("errorifexists").parquet(path)


@dataclass
class ManifestPart(InputPartition):
    """One file of a stored manifest."""

    path: str


class ProjectFilesReader(DataSourceReader):
    """Reads the files that a manifest names, a partition per manifest file.

    What it reads is limited by options and not by pushed filters: plans that scan a Python source
    several times share what the last scan has pushed.
    """

    def __init__(self, manifest: str, kinds: frozenset[str], most: int | None):
        self.manifest, self.kinds, self.most = manifest, kinds, most

    def partitions(self) -> list[InputPartition]:
        system, base = _system(self.manifest) or (fs.LocalFileSystem(), self.manifest)
        found = system.get_file_info(fs.FileSelector(base))
        scheme = self.manifest.partition("://")[0] + "://" if "://" in self.manifest else ""
        return [ManifestPart(f"{scheme}{i.path}") for i in found if i.path.endswith(".parquet")] or [ManifestPart("")]

    def read(self, partition: ManifestPart) -> Iterator[tuple]:
        if not partition.path:
            return
        system, path = _system(partition.path) or (fs.LocalFileSystem(), partition.path)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(1000):
                rows = pa.Table.from_batches([batch]).to_pandas(integer_object_nulls=True)
                for row in rows.itertuples(index=False):
                    known = pd.notna(row.length)
                    if self.kinds and row.kind not in self.kinds or self.most is not None and not (known and row.length <= self.most):
                        continue
                    project, inside, length, link, readable, content = _filled(row)
                    yield project, inside, int(length) if known else None, bool(link), bool(readable), content, row.kind


class ProjectFiles(DataSource):
    """``project_files``: the file table of a stored manifest, its content read when it is scanned."""

    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return f"{_FILES}, kind string"

    def reader(self, schema) -> ProjectFilesReader:
        kinds, most = self.options.get("kinds", ""), self.options.get("maxlength", "")
        return ProjectFilesReader(self.options["manifest"], frozenset(filter(None, kinds.split(","))), int(most) if most else None)


def files_table(spark: SparkSession, manifest: str, kinds: Sequence[str] = (), max_length: int | None = None) -> DataFrame:
    """The file table of a manifest that ``write_manifest`` has stored, read when it is scanned.

    Of other ``kinds``, or longer than ``max_length``, no file is opened and no row returned.
    """
    spark.dataSource.register(ProjectFiles)
    reader = spark.read.format(ProjectFiles.name()).option("manifest", manifest).option("kinds", ",".join(kinds))
    return (reader if max_length is None else reader.option("maxlength", str(max_length))).load()
