"""The first line of each file of a folder as a Spark data source, which reads little more than those lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIRST_READ, MOST_READ = 4096, 1 << 20
FILES_PER_TASK = 1000


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """A path's file system, the path in it, and what to put in front of paths to have them as Spark shows them.
    A path without a scheme is a local one; else file, hdfs, s3, gs or abfs, as Arrow has them."""
    if re.match(r"(file:/*|/)", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", path).lstrip("/"), "file://"
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner, path[: path.index(inner)] if inner in path else ""


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.per_task = options["path"], int(options.get("filesPerTask", FILES_PER_TASK))
        self.suffix = options.get("suffix", "")

    def partitions(self) -> list[Files]:
        """Names alone are listed here, as Spark's own file sources do."""
        found, inner, _ = opened(self.path)
        info = found.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [info] if info.type == fs.FileType.File else found.get_file_info(fs.FileSelector(inner, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) and "=" not in x for x in p[len(inner) :].split("/"))
        paths = sorted(x.path for x in infos if x.type == fs.FileType.File and x.path.endswith(self.suffix) and not hidden(x.path))
        return [Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        found, _, front = opened(self.path)
        for path in partition.paths:
            with found.open_input_file(path) as f:
                parts, step, n = [], FIRST_READ, 0
                while block := f.read(step):
                    n += len(block)
                    end = re.search(rb"[\r\n]", block)
                    parts.append(block[: end.start()] if end else block)
                    if end:
                        break
                    step = min(step * 2, MOST_READ)
            try:
                line = b"".join(parts).decode("utf-8")
            except UnicodeDecodeError:
                line = None
            yield front + path, line, n


class FirstLines(DataSource):
    """format("first_lines").load(folder or file): file_path, value (the first line without its end, of any length; empty for an
    empty file, null if it isn't UTF-8) and bytes_read. Folders are read to any depth, without names that begin with `_` or
    `.`; options: suffix of names, filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "first_lines"

    def schema(self) -> str:
        return "file_path string, value string, bytes_read bigint"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)
