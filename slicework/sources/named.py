"""A sink that writes each row's bytes to a file of the row's own name.

Tasks write to a folder of the job's below ``_temporary``, note the names that they are about to give, and then move
their files there; the driver writes ``_SUCCESS`` when all have. A task that runs again finds its files done. When
the job fails, the files that it gave names to go. Readers skip names that begin with an underscore.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    files: int


def _checked(name: str | None, seen: set[str]) -> str:
    """The name, if it stays below the root, is visible to readers, and is not taken in this task."""
    parts = (name or "").split("/")
    if not name or name in seen or any(p in ("", ".", "..") or p[0] in "_." for p in parts):
        raise ValueError(f"not a name for a file, or a second one: {name!r}")
    seen.add(name)
    return name


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, root, f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root, temporary = self._open()
        task = TaskContext.get()
        own = f"{temporary}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(own)
        names, seen = [], set()
        for batch in iterator:
            paths, contents = batch.column(batch.schema.get_field_index("path")), batch.column(batch.schema.get_field_index("content"))
            for i in range(batch.num_rows):
                names.append(_checked(paths[i].as_py(), seen))
                with fs.open_output_stream(f"{own}/{len(names)}") as out:
                    out.write(contents[i].as_py() or b"")
        taken = self._taken(fs, root, own, names)
        fresh = [x for x in names if x not in taken]
        with fs.open_output_stream(f"{own}/names") as out:
            out.write("\n".join(fresh).encode())
        for folder in {posixpath.dirname(x) for x in names}:
            fs.create_dir(f"{root}/{folder}" if folder else root)
        for i, name in enumerate(names):
            if name not in taken or self.overwrite:
                fs.move(f"{own}/{i + 1}", f"{root}/{name}")
        return Written(len(names))

    def _taken(self, fs: pafs.FileSystem, root: str, own: str, names: list[str]) -> set[str]:
        """Names that files have already; without ``overwrite`` only with the same bytes, as after a task's first try."""
        found = {name: i for i, name in enumerate(names) for info in fs.get_file_info([f"{root}/{name}"]) if info.type != pafs.FileType.NotFound}
        for name, i in found.items():
            if not self.overwrite and fs.open_input_file(f"{root}/{name}").read() != fs.open_input_file(f"{own}/{i + 1}").read():
                raise FileExistsError(f"{name} exists with other bytes")
        return set(found)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root, temporary = self._open()
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m is not None)).encode())
        if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
            fs.delete_dir(temporary)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root, temporary = self._open()
        if fs.get_file_info(temporary).type == pafs.FileType.NotFound:
            return
        for info in fs.get_file_info(pafs.FileSelector(temporary, recursive=True)):
            if info.base_name == "names":
                for name in filter(None, fs.open_input_file(info.path).read().decode().split("\n")):
                    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                        fs.delete_file(f"{root}/{name}")
        fs.delete_dir(temporary)


class NamedFiles(DataSource):
    """Rows ``path`` (below the root) and ``content`` as files."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError(f"columns path and content are needed; there are {schema.names}")
        return NamedFilesWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, root: str, overwrite: bool = False) -> None:
    """Each row's ``content`` as the file ``path`` below ``root``, any file system that Arrow knows. Two rows of one
    name, or a name that another file has, are errors unless their bytes are the same or ``overwrite`` is set."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("path", "content").write.format("named_files").mode("overwrite" if overwrite else "append").save(root)
