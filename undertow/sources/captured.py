"""Captured inputs as Spark data sources: source archives and paged responses.

    captured.register(spark)
    spark.read.format("source_archive").option("prefix", "app/").load("archives/")
    spark.read.format("paged_responses").option("number", "1527,1530").load("responses/")

An archive or a page is a partition, read as a stream in its task. The options `archive`, `number` and `page` (lists with commas)
drop files by their names before any is opened, and `prefix` drops members of an archive before their bytes are kept. They are
options and no pushed conditions, as Spark 4.1.2 keeps the partitions of a DataFrame's earlier scan: after one with a pushed
condition, a scan without any gives that one's rows. Folders are listed by Arrow's file systems (local ones, hdfs and the object
stores it knows), each file once, in the order of names; files of other names are passed over.
"""

from __future__ import annotations

import json
import re
import tarfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from undertow.operators.code import CODE_FILE
from undertow.sources.artifacts import PRUNED

_PAGE = re.compile(r"^(?:.*[-_.])?(\d+)[-_.]page[-_.]?(\d+)\.json$")


class _File(D.InputPartition):
    def __init__(self, path: str, **known):
        super().__init__(path)
        self.path, self.known = path, known


class _Reader(D.DataSourceReader):
    """Lists the files that a rule on their names and the options admit."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.wanted = {name: options[name].split(",") for name in ("archive", "number", "page") if options.get(name)}

    def file(self, path: str, name: str) -> _File | None:
        raise NotImplementedError

    def partitions(self) -> list[_File]:
        where, folder = fs.FileSystem.from_uri(self.folder)
        one = where.get_file_info(folder)
        infos = [one] if one.type == fs.FileType.File else where.get_file_info(fs.FileSelector(folder, recursive=True))
        found = [self.file(i.path, i.base_name) for i in sorted(infos, key=lambda i: i.path) if i.type == fs.FileType.File]
        return [f for f in found if f is not None and all(str(f.known[k]) in v for k, v in self.wanted.items() if k in f.known)]

    def open(self, path: str):
        return fs.FileSystem.from_uri(self.folder)[0].open_input_stream(path)


class _Archives(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.most, self.prefix = int(options.get("most_bytes", 2_000_000)), options.get("prefix", "")

    def file(self, path: str, name: str) -> _File | None:
        return _File(path, archive=name) if re.search(r"\.(tar\.gz|tgz|tar)$", name) else None

    def read(self, partition: _File | None) -> Iterator[tuple]:
        """Members go by as a stream; the bytes of those that are not asked for are never held."""
        if partition is None:  # no file fits
            return
        archive = partition.known["archive"]
        with self.open(partition.path) as stream, tarfile.open(fileobj=stream, mode="r|*") as members:
            for m in members:
                path = m.name.removeprefix("./").partition("/")[2]  # below the archive's own folder
                if m.isfile() and m.size <= self.most and re.search(CODE_FILE, path) and not re.search(PRUNED, f"/{path}") and path.startswith(self.prefix):
                    yield archive, path, members.extractfile(m).read().decode("utf-8", "replace")


class _Pages(_Reader):
    def file(self, path: str, name: str) -> _File | None:
        m = _PAGE.match(name)
        return _File(path, number=int(m[1]), page=int(m[2])) if m else None

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # no file fits
            return
        with self.open(partition.path) as stream:
            for at, item in enumerate(json.loads(stream.read())):
                yield partition.known["number"], partition.known["page"], at, json.dumps(item, ensure_ascii=False)


class SourceArchives(D.DataSource):
    """(archive, path, source): code files of tar archives, without .git, node_modules and members beyond `most_bytes`."""

    @classmethod
    def name(cls) -> str:
        return "source_archive"

    def schema(self) -> str:
        return "archive string, path string, source string"

    def reader(self, schema) -> _Archives:
        return _Archives(self.options)


class PagedResponses(D.DataSource):
    """(number, page, at, item): items of the JSON arrays in files named <number>-page-<page>.json, one page a file."""

    @classmethod
    def name(cls) -> str:
        return "paged_responses"

    def schema(self) -> str:
        return "number int, page int, at int, item string"

    def reader(self, schema) -> _Pages:
        return _Pages(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceArchives)
    spark.dataSource.register(PagedResponses)
