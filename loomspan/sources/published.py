"""Files that are published as a whole: a sink ``published`` of rows ``name, content``, a file a row.

Each run has a folder, each write of it one in that, each attempt of a task one in that. On commit the run's manifest names the attempts that
count and ``_latest`` names the run, so that readers see all files of a run or none: what failed, was killed or ran twice is in no manifest. On
abort the write's folder goes; tasks that still run can't make it again and fail. Earlier runs stay as an archive, unless the write overwrites.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .stores import store

LATEST, MANIFEST = "_latest", "_manifest"


def _put(system: fs.FileSystem, path: str, text: str) -> None:
    """Replaces a small file at once."""
    with system.open_output_stream(f"{path}.new") as f:
        f.write(text.encode())
    system.move(f"{path}.new", path)


def _get(system: fs.FileSystem, path: str) -> str | None:
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read().decode()


def _folders(system: fs.FileSystem, path: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.Directory)


def _remove(system: fs.FileSystem, path: str) -> None:
    """Deletes a folder, again where a task that still runs wrote into it meanwhile."""
    for left in (2, 1, 0):
        try:
            if system.get_file_info(path).type == fs.FileType.Directory:
                system.delete_dir(path)
            return
        except OSError:
            if not left:
                raise


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class PublishedWriter(DataSourceWriter):
    def __init__(self, where: str, run: str, overwrite: bool):
        self.where, self.run, self.overwrite = where, run, overwrite
        self.folder = f"write-{uuid.uuid4().hex}"
        system, base = store(where)
        system.create_dir(f"{base}/{run}/{self.folder}")

    def write(self, iterator: Iterator[Row]) -> Attempt:
        system, base = store(self.where)
        own = f"{base}/{self.run}/{self.folder}"
        folder, n, made = f"part-{uuid.uuid4().hex}", 0, set()
        for row in iterator:
            name, content = row["name"], row["content"]
            steps = name.split("/")
            if not all(s and s not in (".", "..") for s in steps) or steps[0].startswith("_"):
                raise ValueError(f"no name of a file: {name!r}")
            parent = own
            for step in (folder, *steps[:-1]):
                parent = f"{parent}/{step}"
                if parent not in made:
                    system.create_dir(parent, recursive=False)
                    made.add(parent)
            path = f"{parent}/{steps[-1]}"
            if system.get_file_info(path).type != fs.FileType.NotFound:
                raise ValueError(f"a file is written twice: {name!r}")
            with system.open_output_stream(path) as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            n += 1
        return Attempt(f"{self.folder}/{folder}", n)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, base = store(self.where)
        done = [m for m in messages if m is not None and m.files]
        _put(system, f"{base}/{self.run}/{MANIFEST}", json.dumps({"folders": [m.folder for m in done], "files": sum(m.files for m in done)}))
        _put(system, f"{base}/{LATEST}", self.run)
        own, counts = f"{base}/{self.run}/{self.folder}", {m.folder for m in done}
        lost = [p for p in _folders(system, f"{base}/{self.run}") if p != own]
        lost += [p for p in _folders(system, own) if f"{self.folder}/{p.rsplit('/', 1)[-1]}" not in counts]
        if self.overwrite:
            lost += [p for p in _folders(system, base) if p.rsplit("/", 1)[-1] != self.run]
        for path in lost:
            _remove(system, path)

    def abort(self, messages: list[Attempt | None]) -> None:
        system, base = store(self.where)
        _remove(system, f"{base}/{self.run}/{self.folder}")
        if _get(system, f"{base}/{self.run}/{MANIFEST}") is None and not _folders(system, f"{base}/{self.run}"):
            _remove(system, f"{base}/{self.run}")


class Published(DataSource):
    """Sink of ``name`` (with folders, if any; unique in a run) and ``content`` (text, or bytes; null: an empty file).

    Options: ``run``, by default the time and a random part. A run that is written again is replaced when the new one commits; one writer a run at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: object, overwrite: bool) -> PublishedWriter:
        run = self.options.get("run") or f"{datetime.now(UTC):%Y%m%d-%H%M%S-%f}-{uuid.uuid4().hex[:8]}"
        if "/" in run or run.startswith("_"):
            raise ValueError(f"no name of a run: {run!r}")
        return PublishedWriter(self.options["path"], run, overwrite)


def publish(files: DataFrame, path: str, run: str | None = None, overwrite: bool = False) -> None:
    """Writes ``name, content`` as files of a new run."""
    files.sparkSession.dataSource.register(Published)
    w = files.select("name", "content").write.format("published").mode("overwrite" if overwrite else "append")
    (w.option("run", run) if run else w).save(path)


def runs(path: str) -> list[str]:
    """Committed runs, by name."""
    system, base = store(path)
    return [p.rsplit("/", 1)[-1] for p in _folders(system, base) if _get(system, f"{p}/{MANIFEST}") is not None]


def folders(path: str, run: str | None = None) -> list[str]:
    """Folders that hold the files of a run, by default the latest; an error where none is committed. They are as many as the tasks that wrote."""
    system, base = store(path)
    run = run or _get(system, f"{base}/{LATEST}")
    told = run and _get(system, f"{base}/{run}/{MANIFEST}")
    if not told:
        raise FileNotFoundError(f"no such run under {path}: {run}")
    return [f"{path.rstrip('/')}/{run}/{x}" for x in json.loads(told)["folders"]]


def name_of(path: Column | str) -> Column:
    """The name under which a file was published, of its path."""
    return F.regexp_extract(path, "/part-[0-9a-f]{32}/(.*)$", 1)


def read_published(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """``name, content`` of a run's files; those without bytes have no row, as Spark's readers pass over them."""
    where = folders(path, run)
    if not where:
        return spark.createDataFrame([], "name string, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select(name_of("path").alias("name"), "content")
