"""A streaming source of a table's changes: first its snapshot, then the log from the snapshot's position on.

A captured table is a folder:

  snapshot/*.parquet      the rows at some position of the log
  position/value=N        a folder whose name is that position
  log/seq=N/*.parquet     the changes at position N: op (c, u or d), row (JSON); complete when _SUCCESS is there

The offset of the stream is (snapshot files done, log position), so that one
checkpoint covers both phases and the hand-over between them: changes up to the
snapshot's position are in the snapshot already and are passed over, those
behind it follow, none lost or doubled, also when the query stops in between.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "phase string, op string, seq long, row string"


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _files(path)
    return sorted(i.path for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)))


class _Part(InputPartition):
    def __init__(self, phase: str, path: str, seq: int):
        self.phase, self.path, self.seq = phase, path, seq


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _snapshot(self) -> list[str]:
        return [p for p in _listed(f"{self.path}/snapshot") if p.endswith(".parquet")]

    def _position(self) -> int:
        found = [int(m[1]) for p in _listed(f"{self.path}/position") if (m := re.search(r"value=(\d+)$", p))]
        return max(found, default=0)

    def _last(self, after: int) -> int:
        """The last position of the log up to which every one behind `after` is complete."""
        there = {int(m[1]): p for p in _listed(f"{self.path}/log") if (m := re.search(r"seq=(\d+)$", p))}
        while after + 1 in there and any(p.endswith("/_SUCCESS") for p in _listed(f"{self.path}/log/seq={after + 1}")):
            after += 1
        return after

    def initialOffset(self) -> dict:
        return {"files": 0, "seq": self._position()}

    def latestOffset(self) -> dict:
        return {"files": len(self._snapshot()), "seq": self._last(self._position())}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        parts = [_Part("snapshot", p, start["seq"]) for p in self._snapshot()[start["files"] : end["files"]]]
        for seq in range(start["seq"] + 1, end["seq"] + 1):
            parts += [_Part("log", p, seq) for p in _listed(f"{self.path}/log/seq={seq}") if p.endswith(".parquet")]
        return parts

    def read(self, part: _Part) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, _ = _files(self.path)
        for batch in pq.ParquetFile(part.path, filesystem=system).iter_batches():
            n = len(batch)
            if part.phase == "snapshot":
                import json

                op, row = pa.array(["r"] * n), pa.array([json.dumps(r, default=str) for r in batch.to_pylist()], pa.string())
            else:
                op, row = batch.column(batch.schema.get_field_index("op")).cast(pa.string()), batch.column(batch.schema.get_field_index("row")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([part.phase] * n, pa.string()), op, pa.array([part.seq] * n, pa.int64()), row], names=["phase", "op", "seq", "row"])


class TableChanges(DataSource):
    """readStream.format("table_changes").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "table_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"))


def table_changes(spark: SparkSession, path: str):
    """The changes of the captured table in this folder, as a stream of (phase, op, seq, row).

    Registered under a name of its own each time, as a name that one session has
    taken can't be used by another.
    """
    name = f"table_changes_{uuid.uuid4().hex}"
    spark.dataSource.register(type("TableChanges", (TableChanges,), {"name": classmethod(lambda cls: name)}))
    return spark.readStream.format(name).load(path)
