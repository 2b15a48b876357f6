"""A streaming source that follows growing log files, which Spark's own file source reads once only.

``register(spark)``, then ``spark.readStream.format("log_tail").option("path", folder).load()`` gives ``file, position, line``:
each complete line once, with the byte at which it starts. Folders of any store that pyarrow reads are followed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Piece(InputPartition):
    """The bytes ``start`` to ``end`` of a file; lines that start there are read, the last one to its end."""

    def __init__(self, file: str, start: int, end: int, whole: bool):
        self.file, self.start, self.end, self.whole = file, start, end, whole


class LogReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file. A batch ends at the last line feed that a file has, so a line that is still being
    written waits. A file that has become shorter was begun anew and is read from its start; one that is gone is forgotten."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.piece_bytes = int(options.get("pieceBytes", 64 << 20))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _files(self):
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return store, sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(self.suffix))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, files = self._files()
        return {"files": {name: self._complete(store, name, size) for name, size in files}}

    def _complete(self, store, name: str, size: int, step: int = 1 << 16) -> int:
        """Bytes up to the last line feed, looked for from the end."""
        with store.open_input_file(name) as file:
            end = size
            while end > 0:
                begin = max(0, end - step)
                at = file.read_at(end - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, size in end["files"].items():
            seen = start["files"].get(name, 0)
            seen = seen if seen <= size else 0
            for at in range(seen, size, self.piece_bytes):
                out.append(Piece(name, at, min(at + self.piece_bytes, size), at == seen))
        return out

    def read(self, piece: Piece) -> Iterator[tuple[str, int, str]]:
        import io

        store, _ = self._store()
        with io.BufferedReader(store.open_input_file(piece.file)) as file:
            at = piece.start
            if not piece.whole:
                # The line that an earlier piece has begun is that piece's.
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < piece.end:
                raw = file.readline()
                if not raw:
                    return
                yield piece.file, at, raw.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(raw)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, position long, line string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
