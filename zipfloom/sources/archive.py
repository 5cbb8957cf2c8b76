"""A data source for token lines in zip members of a tar file.

``spark.dataSource.register(TokenArchive)``, then
``spark.read.format("token_archive").load(path)``.  One partition per zip
member; within it files in order of name.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, line_no bigint, doc_id string, surface string, lemma string, pos string"


class _Member(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Member]:
        with tarfile.open(self.path) as tar:
            return [_Member(n) for n in tar.getnames() if n.lower().endswith(".zip")]

    def read(self, partition: _Member) -> Iterator[tuple]:
        with tarfile.open(self.path) as tar:
            member = tar.extractfile(partition.name)
            if member is None:
                return
            with zipfile.ZipFile(member) as z:
                for name in sorted(z.namelist()):
                    with z.open(name) as raw:
                        for n, line in enumerate(io.TextIOWrapper(raw, "utf-8", "ignore", newline="\n")):
                            parts = line.rstrip("\r\n").split("\t")
                            if len(parts) == 4:
                                doc, surface, lemma, pos = parts
                                yield f"{partition.name}/{name}", n, doc.strip(), surface, lemma.strip().lower(), pos.strip().lower()


class TokenArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])
