"""One JSON file for each document, named by its page: a data source with a two-phase commit.

A task writes its files into a staging folder of its own attempt.  Only when
all tasks are done are the files moved to where readers look, those of the
attempts that Spark has accepted; a job that fails removes its staging folder
and leaves no file.  Readers skip the staging folder, whose name begins with an
underscore.  Between tasks and driver go the names of staging folders alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillgraph.functions import names
from quillgraph.sinks.documents import mixes_json

FORMAT = "quillgraph_page_files"
# Files that the commit moves side by side.
MOVES = 16


def _filesystem(path: str):
    """File system and path of ``path``, which may be a URI; Hadoop writes local ones with one slash."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class PageFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        fs, root = _filesystem(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        seen: set[str] = set()
        for row in iterator:
            if row.name is None or row.body is None:
                raise ValueError("a document without a name or a body")
            if row.name in seen:
                raise ValueError(f"two documents are called {row.name}")
            seen.add(row.name)
            with fs.open_output_stream(f"{folder}/{row.name}.json") as out:
                out.write(row.body.encode("utf-8"))
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            if self.overwrite:
                old = [f.path for f in fs.get_file_info(FileSelector(root)) if f.is_file and f.path.endswith(".json")]
                list(pool.map(fs.delete_file, old))
            for message in messages:
                if message is not None:
                    staged = fs.get_file_info(FileSelector(message.folder))
                    list(pool.map(lambda f: fs.move(f.path, f"{root}/{f.base_name}"), staged))
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = _filesystem(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type.name == "Directory":
            fs.delete_dir(f"{root}/{self.staging}")


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> PageFilesWriter:
        return PageFilesWriter(self.options["path"], overwrite)


def write_pages(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``(page, body)`` as ``<sanitised page>.json`` each.

    ``overwrite`` replaces the documents of the folder, ``append`` adds to them
    and replaces those of the same name.  Two rows of one page, a null page or
    a null body end the job, and the folder stays as it was.
    """
    spark = docs.sparkSession
    spark.dataSource.register(PageFiles)
    # Rows of one name meet in one task, which sees that there are two.
    named = docs.select(names.sanitize("page").alias("name"), "body").repartition("name")
    named.write.format(FORMAT).mode(mode).save(path)


def _moment(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(column)


def write_genre_pages(docs: DataFrame, path: str) -> None:
    """``genre_docs`` as a file per genre; ``mixes`` is left out where there are none."""
    fields = F.to_json(F.struct("description", _moment("last_revision_date"), "top_artists"), {"ignoreNullFields": "false"})
    mixes = F.when(F.col("mixes").isNotNull(), F.concat(F.lit(',"mixes":'), mixes_json(), F.lit("}"))).otherwise(F.lit("}"))
    write_pages(docs.select("page", F.concat(F.regexp_replace(fields, r"\}$", ""), mixes).alias("body")), path)


def write_artist_pages(docs: DataFrame, path: str) -> None:
    """``artist_docs`` as a file per artist."""
    fields = F.struct("name", _moment("last_revision_date"), "description", "genres")
    write_pages(docs.select("page", F.to_json(fields, {"ignoreNullFields": "false"}).alias("body")), path)
