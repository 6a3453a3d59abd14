"""A source tree as a Spark data source, and the scan on top of it.

The reader walks the tree under the ignore rules, in parts made of its topmost levels, and prunes ignored
folders. It yields a row for each entry: folders, files with their bytes, and what was passed over. The root must
be a path that executors can read too (a shared file system on a cluster).
"""

from __future__ import annotations

import datetime
import json
import os
import re
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions import files as fl
from corvane.schemas import ScanError

ENTRIES = "entry string, relative_path string, absolute_path string, size_bytes bigint, last_modified timestamp, content binary"
MAX_BYTES = 10 * 1024 * 1024
#: Entries that the driver lists at least before it packs them, in so many levels at most, and bytes of a part.
LEAST_UNITS, OPENED_LEVELS, PART_BYTES = 256, 4, 8 * 1024 * 1024
#: Read at the root, in this order; later rules win.
IGNORE_FILES = (".gitignore", ".corvaneignore")


class RepositoryEntries(DataSource):
    """Options: root, maxBytes, rules (JSON of ignore_rules), names (JSON of path parts that are never read)."""

    @classmethod
    def name(cls) -> str:
        return "corvane_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema):
        return _Reader(self.options)


class _Part(InputPartition):
    """Entries to read: paths, each with whether what is below it is meant too."""

    def __init__(self, entries: list[tuple[str, bool]]) -> None:
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.most = options["root"], int(options.get("maxBytes", MAX_BYTES))
        self.rules = [(re.compile(regex), negated, folders) for regex, negated, folders in json.loads(options.get("rules", "[]"))]
        self.names = set(json.loads(options.get("names", "[]")))

    def partitions(self):
        """The tree's entries, folders opened level by level until there are enough of them, packed by size."""
        units = [(n, True) for n in sorted(os.listdir(self.root))]
        for _ in range(OPENED_LEVELS):
            if len(units) >= LEAST_UNITS:
                break
            wider = []
            for path, deep in units:
                full = os.path.join(self.root, path)
                if deep and not self._ignored(path, True) and os.path.isdir(full) and not os.path.islink(full):
                    wider += [(path, False), *((f"{path}/{n}", True) for n in sorted(os.listdir(full)))]
                else:
                    wider.append((path, deep))
            if wider == units:
                break
            units = wider
        packs: list[list[tuple[str, bool]]] = [[]]
        size = 0
        for path, deep in units:
            full = os.path.join(self.root, path)
            # a folder's size is not known: it fills a part by itself
            weight = os.lstat(full).st_size if os.path.isfile(full) else PART_BYTES if deep and os.path.isdir(full) else 0
            if packs[-1] and size + weight > PART_BYTES:
                packs.append([])
                size = 0
            packs[-1].append((path, deep))
            size += weight
        return [_Part(p) for p in packs if p]

    def read(self, part):
        for path, deep in part.entries:
            yield from self._entry(path, deep)

    def _ignored(self, path: str, folder: bool) -> bool:
        if self.names & set(path.split("/")):
            return True
        out = False
        for regex, negated, folders in self.rules:
            if (folder or not folders) and regex.search(path):
                out = not negated
        return out

    def _entry(self, path: str, deep: bool = True):
        full = os.path.join(self.root, path)
        try:
            facts = os.lstat(full)
        except FileNotFoundError:
            return
        folder = stat.S_ISDIR(facts.st_mode)
        when = datetime.datetime.fromtimestamp(facts.st_mtime)
        row = lambda kind, content=None: (kind, path, full, facts.st_size, when, content)
        if self._ignored(path, folder):
            yield row("ignored")
        elif folder:
            yield row("folder")
            for name in sorted(os.listdir(full)) if deep else ():
                yield from self._entry(f"{path}/{name}")
        elif not stat.S_ISREG(facts.st_mode) or facts.st_size > self.most:
            yield row("ignored")  # links are never followed, and large files never read
        else:
            with open(full, "rb") as f:
                yield row("file", f.read())


def access_error(error: OSError) -> str:
    """The class of a file system error."""
    kinds = {"not-found": FileNotFoundError, "permission-denied": PermissionError, "invalid-entry": (NotADirectoryError, IsADirectoryError)}
    return next((name for name, kind in kinds.items() if isinstance(error, kind)), "unknown")


def reread(asked: DataFrame) -> DataFrame:
    """Source provider: id, relative_path, content and content_hash of files (id, relative_path, absolute_path) as they are now.

    A file that cannot be read has no content. The paths must be readable on executors, as for the scan.
    """

    def read(batches):
        for batch in batches:
            got = []
            for path in batch.column(2).to_pylist():
                try:
                    with open(path, "rb") as f:
                        got.append(f.read())
                except OSError:
                    got.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["id", "relative_path", "content"])

    found = asked.select("id", "relative_path", "absolute_path").mapInArrow(read, "id string, relative_path string, content binary")
    return found.withColumn("content_hash", F.sha2("content", 256))


def _optional_text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except FileNotFoundError:
        return None


def scan_entries(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignore_files=IGNORE_FILES, names=fl.IGNORED_NAMES) -> DataFrame:
    """All entries of a tree under its ignore rules. Raises a ScanError that says what is wrong with the root."""
    if not isinstance(max_bytes, int) or isinstance(max_bytes, bool) or max_bytes < 0:
        raise ScanError("SCAN_FAILED", "Maximum file size must be a non-negative safe integer.")
    path = os.path.abspath(root)
    try:
        if not stat.S_ISDIR(os.lstat(path).st_mode):
            raise ScanError("INVALID_REPOSITORY", f"Not a directory: {path}")
        path = os.path.realpath(path)
        os.listdir(path)
        rules = fl.ignore_rules(*[_optional_text(os.path.join(path, f)) for f in ignore_files])
    except OSError as e:
        code, message = {"not-found": ("REPOSITORY_NOT_FOUND", "Repository not found"), "permission-denied": ("PERMISSION_DENIED", "Permission denied")}.get(access_error(e), ("SCAN_FAILED", "Could not scan repository"))
        raise ScanError(code, f"{message}: {path}") from e
    spark.dataSource.register(RepositoryEntries)
    options = {"root": path, "maxBytes": str(max_bytes), "rules": json.dumps(rules), "names": json.dumps(list(names))}
    return spark.read.format("corvane_entries").options(**options).load()


def scan_tables(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scan_files with their `content`, and one row of counts: files, directories, ignored entries."""
    ext = fl.extension("relative_path")
    text = F.when(F.col("entry") == "file", ~fl.is_binary("content")).otherwise(False)
    files = entries.where(text).select(
        F.sha2(F.col("relative_path").cast("binary"), 256).alias("id"), "relative_path", "absolute_path", ext.alias("extension"), fl.language(ext).alias("language"), "size_bytes", F.sha2("content", 256).alias("content_hash"), "last_modified", "content"
    )
    counts = entries.agg(F.count_if(text).alias("total_files"), F.count_if(F.col("entry") == "folder").alias("total_directories"), F.count_if((F.col("entry") != "folder") & ~text).alias("total_ignored_entries"))
    return files, counts
