"""Table artefacts as a Spark sink: two files for each table, page_<n>_table_<i>.csv (all values quoted) and .json (rows and structure), in a folder for each document.

Tasks write into a staging folder of the job. Only when all have ended, the driver moves what their commit messages name into
place; a task that failed or was started twice leaves nothing but staged files, which go with the staging folder. Artefacts of an
earlier run that this one did not write again are deleted for the documents that it wrote.

The files are written through pyarrow's file systems, so the folder can be in any store that these reach.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "table_artifacts"
SCHEMA = "document_id string, page_no long, table_index int, cells array<array<string>>"


@dataclass
class Staged(WriterCommitMessage):
    #: (staged file, document's folder, file name)
    files: list[tuple[str, str, str]]


def folder_of(document_id: str) -> str:
    """A document's folder name: what is no letter, digit, dot, dash or underscore becomes an underscore; ValueError where nothing sound is left."""
    name = re.sub(r"[^\w.-]", "_", document_id or "")
    if not name.strip("._"):
        raise ValueError(f"no folder for {document_id!r}")
    return name


def render(cells: list[list[str | None]]) -> tuple[bytes, bytes]:
    """The CSV and JSON of one table."""
    from ..operators.documents import table_structure

    depth, confidence, paths, n_rows, n_columns, flags = table_structure(cells)
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerows([["" if c is None else c for c in r] for r in cells])
    payload = {"raw_rows": cells, "header_depth": depth, "confidence": confidence, "column_paths": paths, "body_start_row": depth, "row_count": n_rows, "column_count": n_columns, "quality_flags": flags}
    return out.getvalue().encode(), (json.dumps(payload, ensure_ascii=False, indent=2) + "\n").encode()


class ArtifactWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, rows: Iterator[Row]) -> Staged:
        store, root = self._at()
        own, files = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        for n, r in enumerate(rows):
            name = f"page_{r['page_no']}_table_{r['table_index']}"
            cells = [list(x) if x is not None else [] for x in r["cells"] or []]
            for kind, body in zip(("csv", "json"), render(cells), strict=True):
                with store.open_output_stream(f"{own}/{n}.{kind}") as out:
                    out.write(body)
                files.append((f"{own}/{n}.{kind}", folder_of(r["document_id"]), f"{name}.{kind}"))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self._at()
        written: dict[str, set[str]] = {}
        for m in messages:
            for staged, folder, name in m.files if m else []:
                if folder not in written:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                store.move(staged, f"{root}/{folder}/{name}")
                written.setdefault(folder, set()).add(name)
        for folder, names in written.items():
            for f in store.get_file_info(fs.FileSelector(f"{root}/{folder}")):
                if re.fullmatch(r"page_\d+_table_\d+\.(csv|json)", f.base_name) and f.base_name not in names:
                    store.delete_file(f.path)
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._at())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"])


def table_artifacts(tables: DataFrame, path: str) -> None:
    """Write tables (document_id, page_no, table_index, cells) below path; of tables of one place that are repeated, one is written."""
    tables.sparkSession.dataSource.register(ArtifactSource)
    once = tables.dropDuplicates(["document_id", "page_no", "table_index"])
    once.select("document_id", "page_no", "table_index", "cells").write.format(FORMAT).mode("append").save(path)
