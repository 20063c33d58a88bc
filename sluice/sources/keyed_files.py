"""Files by key, written by the tasks that hold their lines.

Two phases. A task writes each of its files under an attempt's name, hidden from readers, and moves it to
its key when it is whole; stores that show an object only when it is closed need no move. At its end it
lists what it made in a part of the run's manifest and sends that part's name to the driver. The
driver commits the run with one small file that names the parts. So the driver's work
depends on the number of tasks, never on that of the files; a killed task leaves nothing that
a reader sees, and a second attempt puts the same files in the same places.

Files are reached by the URIs that pyarrow's file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sluice.storage import no_leftovers

#: Stores where an object is there as a whole or not at all.
WHOLE_OBJECTS = ("s3", "gcs", "abfs")
RUNS = "_runs"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path in it."""
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1))
    return store, path.rstrip("/")


def put(store: fs.FileSystem, path: str, parts: Iterator[bytes]) -> int:
    """Writes a file that is at ``path`` as a whole or not at all; its size."""
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    made = path if store.type_name in WHOLE_OBJECTS else f"{folder}/._{name}.{uuid.uuid4().hex}"
    size = 0
    with store.open_output_stream(made) as out:
        for part in parts:
            size += len(part)
            out.write(part)
    if made != path:
        store.move(made, path)
    return size


@dataclass
class Made(WriterCommitMessage):
    """A part of a run's manifest, how many files it lists and their bytes."""

    part: str
    files: int
    size: int


class KeyedWriter(DataSourceArrowWriter):
    """Lines (key, record), those of a key side by side and in order, into a file per key."""

    def __init__(self, folder: str, run: str) -> None:
        self.folder, self.run = folder, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Made:
        store, root = store_of(self.folder)
        ahead = _stretches(iterator)
        listed, now = [], next(ahead, None)
        while now is not None:
            key, more = now[0], [now]

            def parts() -> Iterator[bytes]:
                while more[0] is not None and more[0][0] == key:  # noqa: B023
                    yield more[0][1]  # noqa: B023
                    more[0] = next(ahead, None)  # noqa: B023

            listed.append({"key": key, "bytes": put(store, f"{root}/{key}", parts())})
            now = more[0]
        name = f"part-{TaskContext.get().partitionId():06}-{uuid.uuid4().hex}.json"
        put(store, f"{root}/{RUNS}/{self.run}/{name}", (json.dumps(x).encode() + b"\n" for x in listed))
        return Made(name, len(listed), sum(x["bytes"] for x in listed))

    def commit(self, messages: list[Made | None]) -> None:
        store, root = store_of(self.folder)
        made = [m for m in messages if m is not None]
        manifest = {"parts": sorted(m.part for m in made), "files": sum(m.files for m in made), "bytes": sum(m.size for m in made)}
        put(store, f"{root}/{RUNS}/{self.run}/manifest.json", iter([json.dumps(manifest).encode()]))

    def abort(self, messages: list[Made | None]) -> None:
        store, root = store_of(self.folder)
        if store.get_file_info(f"{root}/{RUNS}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{RUNS}/{self.run}")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """key and lines, for each run of lines of one key in a batch."""
    for batch in batches:
        keys, records = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "record"))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                yield keys[first], "".join(f"{r or ''}\n" for r in records[first:i]).encode()
                first = i


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sluice_files"

    def schema(self) -> str:
        return "key string, record string"

    def writer(self, schema, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(self.options["folder"], self.options["run"])


def committed(folder: str, run: str) -> dict | None:
    """The manifest of a run; None if it didn't end."""
    store, root = store_of(folder)
    path = f"{root}/{RUNS}/{run}/manifest.json"
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as file:
        return json.loads(file.read())


def write_keyed(lines: DataFrame, folder: str) -> str:
    """Writes ``lines`` (key, record; those of a key in one partition, in order) and returns the run that is committed."""
    spark, run = lines.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(KeyedFiles)
    with no_leftovers(spark):
        lines.select("key", "record").write.format("sluice_files").option("folder", folder).option("run", run).mode("append").save()
    return run


def remove_others(keys: DataFrame, folder: str) -> None:
    """Deletes the files beside ``keys`` (key) that aren't among them, folder by folder, in tasks; hidden ones stay."""

    def clear(table: pa.Table) -> pa.Table:
        store, root = store_of(folder)
        parent, own = table.column("parent")[0].as_py(), {k.rpartition("/")[2] for k in table.column("key").to_pylist()}
        found = store.get_file_info(fs.FileSelector(f"{root}/{parent}", allow_not_found=True))
        others = [f.path for f in found if f.type == fs.FileType.File and f.base_name not in own and not f.base_name.startswith((".", "_"))]
        for path in others:
            store.delete_file(path)
        return pa.table({"parent": [parent], "deleted": [len(others)]})

    parents = keys.select("key", F.regexp_extract("key", "^(.*)/[^/]*$", 1).alias("parent"))
    with no_leftovers(keys.sparkSession):
        parents.groupBy("parent").applyInArrow(clear, "parent string, deleted long").write.format("noop").mode("overwrite").save()
