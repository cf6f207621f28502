"""Peak files, one a frame under its own name, as a data source that Spark writes to."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .io import PEAK_COLUMNS

#: Folder under the target for files whose task or job has not ended.
OPEN = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder, and the files' paths in it and in the target alike."""

    folder: str = ""
    files: list[str] = field(default_factory=list)


class PeakFiles(DataSource):
    """Rows by frame, each frame in one task and in a row: [scan_id], frame_id, kind (0: a frame's head, 1: a peak), 29
    columns. Options: path, stem, padding."""

    @classmethod
    def name(cls) -> str:
        return "peak_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("peak files are added to a folder; overwriting isn't offered")
        return PeakFileWriter(schema.names, self.options["path"], self.options.get("stem", ""), int(self.options.get("padding", 6)))


def number(v: float | None) -> str:
    """A value as its shortest text that reads back the same; nothing for null."""
    return "" if v is None else "NaN" if math.isnan(v) else repr(float(v)) if math.isfinite(v) else "Inf" if v > 0 else "-Inf"


class PeakFileWriter(DataSourceWriter):
    """Every task attempt writes to a folder of its own. Files of attempts that Spark accepts are moved to the target when
    all tasks have ended; those of failed and doubled attempts never appear there."""

    def __init__(self, names: list[str], path: str, stem: str, padding: int):
        self.names, self.path, self.stem, self.padding = names, path.rstrip("/"), stem, padding
        self.job = uuid.uuid4().hex

    def _store(self):
        """The file system of the path and the path in it; any that Arrow knows, by its URI."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Written:
        store, base = self._store()
        folder = f"{OPEN}/{self.job}/{uuid.uuid4().hex}"
        done, out, now = Written(folder), None, None
        scan = self.names.index("scan_id") if "scan_id" in self.names else None
        frame, first = self.names.index("frame_id"), self.names.index("kind") + 1
        try:
            for row in iterator:
                key = (None if scan is None else row[scan], row[frame])
                if key != now:
                    if out is not None:
                        out.close()
                    name = f"{self.stem}{row[frame] + 1:0{self.padding}d}_PS.csv"
                    name = name if scan is None else f"{row[scan]}/{name}"
                    store.create_dir(f"{base}/{folder}/{name}".rpartition("/")[0], recursive=True)
                    out, now = store.open_output_stream(f"{base}/{folder}/{name}"), key
                    done.files.append(name)
                    out.write(("\t".join(PEAK_COLUMNS) + "\n").encode())
                if row[first - 1]:
                    out.write(("\t".join(map(number, row[first:])) + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        for m in filter(None, messages):
            for name in m.files:
                store.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                store.move(f"{base}/{m.folder}/{name}", f"{base}/{name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        """Takes away what this job has left open; other jobs' folders stay."""
        from pyarrow import fs

        store, base = self._store()
        if store.get_file_info(f"{base}/{OPEN}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{OPEN}/{self.job}")
        rest = store.get_file_info(fs.FileSelector(f"{base}/{OPEN}", allow_not_found=True))
        if not rest and store.get_file_info(f"{base}/{OPEN}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{OPEN}")
