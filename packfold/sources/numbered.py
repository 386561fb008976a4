"""A sink that writes each row to a file of its own name, all at once or not at all.

Tasks write into a staging folder, under the attempt's own name, so that a retried, lost or
speculative attempt leaves nothing that anyone reads. When all tasks have ended, the driver's
commit moves the files of the attempts that counted to their names and removes the staging
folder; if the job fails, only the staging folder has to go.

Files are reached through Arrow's file systems: plain and ``file:`` paths, and the remote
ones (HDFS, S3, GCS) whose libraries the workers have. Every worker must see the same files.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "numbered_files"
SCHEMA = "value string, output_file string"


def file_system(path: str):
    """An Arrow file system and the path in it."""
    from pyarrow import fs

    if re.match("^[A-Za-z][A-Za-z0-9+.-]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)


@dataclass
class Written(WriterCommitMessage):
    """One attempt's files: their number, and the folder that holds them and the list of their names."""

    folder: str
    files: int


class NumberedFiles(DataSource):
    """Sink of (value, output_file) rows; option ``root`` is the folder above all files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> NumberedWriter:
        return NumberedWriter(self.options["root"], self.options.get("replace") == "true")


class NumberedWriter(DataSourceWriter):
    def __init__(self, root: str, replace: bool):
        self.replace = replace
        self.staging = posixpath.join(root, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        """Files 0, 1, ... of this attempt, and a list of the names they are to have."""
        system, folder = file_system(posixpath.join(self.staging, uuid.uuid4().hex))
        count, names = 0, None
        for row in iterator:
            if names is None:
                system.create_dir(folder, recursive=True)
                names = system.open_output_stream(posixpath.join(folder, "names"))
            with system.open_output_stream(posixpath.join(folder, str(count))) as out:
                out.write((row.value or "").encode())
            names.write(row.output_file.encode() + b"\0")
            count += 1
        if names is not None:
            names.close()
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None and m.files]
        if done:
            system, staging = file_system(self.staging)
            try:
                if not self.replace:
                    # nothing is moved before it is known that everything can be
                    for _, path in self._files(system, done):
                        _refuse_existing(system, path)
                made = set()
                for staged, path in self._files(system, done):
                    above = posixpath.dirname(path)
                    if above and above not in made:
                        system.create_dir(above, recursive=True)
                        made.add(above)
                    system.move(staged, path)
            finally:
                system.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, staging = file_system(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)

    @staticmethod
    def _files(system, done: list[Written]) -> Iterator[tuple[str, str]]:
        """(staged, final) paths, attempt by attempt."""
        for message in done:
            with system.open_input_file(posixpath.join(message.folder, "names")) as found:
                number, rest = 0, b""
                while data := found.read(1 << 20):
                    *whole, rest = (rest + data).split(b"\0")
                    for name in whole:
                        yield posixpath.join(message.folder, str(number)), file_system(name.decode())[1]
                        number += 1


def _refuse_existing(system, path: str) -> None:
    from pyarrow import fs

    if system.get_file_info(path).type != fs.FileType.NotFound:
        raise FileExistsError(path)
