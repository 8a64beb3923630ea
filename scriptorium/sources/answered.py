"""Answered requests as files of a shared folder: one small Parquet file a request, moved into place when whole."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq


@dataclass(frozen=True)
class AnsweredRequests:
    """A folder that driver and tasks reach by one address that pyarrow opens (a shared mount, hdfs://, s3://, gs://)."""

    path: str

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    @staticmethod
    def name_of(batch: pd.DataFrame, columns: list[str]) -> str:
        """The digest of the rows' values in `columns`."""
        digest = hashlib.sha256()
        for row in batch[columns].itertuples(index=False):
            digest.update(repr(tuple(row)).encode())
        return digest.hexdigest()

    def find(self, name: str) -> pa.Table | None:
        fs, root = self._open()
        path = f"{root}/{name}.parquet"
        if fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with fs.open_input_file(path) as f:
            return pq.read_table(f)

    def commit(self, name: str, rows: pa.Table) -> None:
        """Written under a hidden name first: readers see whole files only, and a second commit of a request replaces the first by its like."""
        fs, root = self._open()
        fs.create_dir(root, recursive=True)
        hidden = f"{root}/.{name}-{uuid.uuid4().hex}"
        pq.write_table(rows, hidden, filesystem=fs)
        fs.move(hidden, f"{root}/{name}.parquet")

    def is_empty(self) -> bool:
        fs, root = self._open()
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return not any(x.base_name.endswith(".parquet") for x in found)

    def clear(self) -> None:
        fs, root = self._open()
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)
