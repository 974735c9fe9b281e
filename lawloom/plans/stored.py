"""Tables in the shared folder that workers read part by part, so that nothing goes through the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas
import pyarrow
import pyarrow.fs
import pyarrow.parquet


class StoredTable:
    """A Parquet table with a column `part`, written by Spark to the shared folder; a worker holds one row group of a part at a time.

    by_folder: each part has a folder of its own (Spark's partitionBy), so that a worker opens no other.
    """

    def __init__(self, path: str, by_folder: bool = False) -> None:
        self.path, self.by_folder = path, by_folder

    def _files(self, folder: str = "") -> tuple[pyarrow.fs.FileSystem, list[str]]:
        system, root = pyarrow.fs.FileSystem.from_uri(self.path)
        return system, sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(root + folder, allow_not_found=bool(folder), recursive=True)) if f.path.endswith(".parquet"))

    def part(self, part: int, *columns: str) -> Iterator:
        """The values of the columns in the rows of a part, a tuple each (or the bare value of one column)."""
        if self.by_folder:
            yield from self.rows(*columns, folder=f"/part={part}")
            return
        system, files = self._files()
        for name in files:
            table = pyarrow.parquet.read_table(name, columns=["part", *columns], filters=[("part", "=", part)], filesystem=system)
            values = [table.column(c).to_pylist() for c in columns]
            yield from values[0] if len(columns) == 1 else zip(*values, strict=True)

    def record_batches(self, *columns: str, rows: int = 5_000, folder: str = "") -> Iterator[pyarrow.RecordBatch]:
        """The columns of all rows, some at a time, always in the same order."""
        system, files = self._files(folder)
        for name in files:
            with system.open_input_file(name) as source:
                yield from pyarrow.parquet.ParquetFile(source).iter_batches(batch_size=rows, columns=list(columns))

    def batches(self, *columns: str, rows: int = 5_000) -> Iterator[pandas.DataFrame]:
        for batch in self.record_batches(*columns, rows=rows):
            yield batch.to_pandas()

    def rows(self, *columns: str, folder: str = "") -> Iterator[tuple]:
        """The values of the columns, a tuple for each row, in the order of record_batches."""
        for batch in self.record_batches(*columns, folder=folder):
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
