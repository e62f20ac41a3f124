"""A sink of documents: one JSON file a row, all or none of a write's files, through Spark's data source interface.

Each task writes its documents under names of its own; when all tasks are done the commit gives them their names, so a reader sees whole
documents alone, and a task that is run twice leaves one. `spark.dataSource.register(Documents)`, then
`df.write.format("documents").option("path", folder).option("name", column).mode("append").save()`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a document lies, and the name that it gets


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.column, self.overwrite = options["path"], options.get("name", "model_id"), overwrite

    def write(self, iterator: Iterator) -> Written:
        system, root = _place(self.path)
        system.create_dir(f"{root}/_parts", recursive=True)
        files = []
        for row in iterator:
            own = row.asDict(recursive=True)
            name = re.sub(r"[^\w.-]", "_", str(own[self.column]))
            part = f"{root}/_parts/{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(json.dumps(own, ensure_ascii=False, indent=2, default=str).encode())
            files.append((part, f"{root}/{name}.json"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"two documents have one name in the column {self.column}")
        if self.overwrite:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(root)):
                if old.path.endswith(".json"):
                    system.delete_file(old.path)
        for part, name in files:  # a row a model
            system.move(part, name)
        system.delete_dir(f"{root}/_parts")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _place(self.path)
        for m in messages:
            for part, _ in m.files if m else []:
                system.delete_file(part)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)
