"""Growing files of lines as a stream: a Python data source whose offsets are bytes.

    spark.dataSource.register(TailSource)
    spark.readStream.format("line_tail").option("suffix", ".jsonl").load(folder)

An offset holds, for each file, who it is and how far its whole lines reach. Who a file is says its first line, and
where the file system has them its device and inode. So a trigger reads what has been added, and nothing twice:
a file that is replaced or cut is read from its beginning, one that is renamed goes on where it was, and a last line without its end
waits. A restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, file_id string, byte bigint, line string"
#: Bytes of a first line that tell a file, bytes of one read, and bytes of one task.
HEAD, CHUNK, PART = 4096, 1 << 20, 64 << 20
#: Files of one task, and files that are looked into at once.
FILES, LOOKS = 1024, 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        if urlparse(path).scheme == "file":
            return pafs.LocalFileSystem(), unquote(urlparse(path).path)
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _who(fs: pafs.FileSystem, path: str, head: bytes) -> str | None:
    line, newline, _ = head.partition(b"\n")
    if not newline and len(head) < HEAD:
        return None
    place = ""
    if isinstance(fs, pafs.LocalFileSystem):
        st = os.stat(path)
        place = f"{st.st_dev}-{st.st_ino}-"
    return f"{place}{zlib.crc32(line):08x}"


def identity(fs: pafs.FileSystem, path: str) -> str | None:
    """Who the file is; None as long as it has no whole line."""
    with fs.open_input_file(path) as f:
        return _who(fs, path, f.read(HEAD))


def looked_into(fs: pafs.FileSystem, path: str, size: int) -> dict | None:
    """A file's entry of an offset: who it is, and where the last whole line of its first `size` bytes ends. A short file is read once for both."""
    with fs.open_input_file(path) as f:
        head = f.read(HEAD)
    who = _who(fs, path, head)
    if not who:
        return None
    return {"id": who, "byte": head.rfind(b"\n", 0, size) + 1 if size <= len(head) else end_of_lines(fs, path, size)}


def end_of_lines(fs: pafs.FileSystem, path: str, size: int) -> int:
    """Where the last whole line of the first `size` bytes ends, read from behind."""
    at = size
    with fs.open_input_file(path) as f:
        while at > 0:
            begin = max(0, at - CHUNK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


@dataclass
class Part(InputPartition):
    """Lines that begin in [begin, end) of a file whose range of this trigger begins at `first`."""

    path: str
    file_id: str
    first: int
    begin: int
    end: int


@dataclass
class Parts(InputPartition):
    """What one task reads: parts of several files, where files are small."""

    parts: list[Part]


def bundled(parts: list[Part], size: int) -> list[Parts]:
    """The parts in tasks of about `size` bytes, and of FILES parts at most."""
    out, room, left = [], 0, 0
    for p in parts:
        if not left or p.end - p.begin > room:
            out.append(Parts([]))
            room, left = size, FILES
        out[-1].parts.append(p)
        room, left = room - (p.end - p.begin), left - 1
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffix = options.get("suffix", "")
        self.idle = float(options.get("minidleseconds", 0))
        self.part = int(options.get("partbytes", PART))
        self.fresh = False
        self.seen: dict[str, tuple] = {}  # path: (size, time of change, entry)
        self.asked = False

    def initialOffset(self) -> dict:
        self.fresh = True
        return {}

    def latestOffset(self) -> dict:
        """Every file that has whole lines. Files that have not changed since the last call are not opened. A file that changed a moment ago waits,
        but right after a restart, when only its offset in the checkpoint says how far it was read."""
        fs, root = file_system(self.folder)
        now, out, seen, changes = time.time(), {}, {}, []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != pafs.FileType.File or not info.path.endswith(self.suffix):
                continue
            changed = info.mtime_ns or 0
            size, before, entry = self.seen.get(info.path, (-1, -1, None))
            if (size, before) != (info.size, changed):
                waits = now - changed / 1e9 < self.idle and (self.fresh or self.asked)
                if not waits:
                    changes.append((info.path, info.size, changed))
                    continue
            seen[info.path] = size, before, entry
            if entry:
                out[info.path] = entry

        def look(change: tuple[str, int, int]) -> dict | None:
            path, size, changed = change
            try:
                entry = looked_into(fs, path, size)
            except FileNotFoundError:
                return None  # it went between the listing and now
            seen[path] = size, changed, entry
            return entry

        with ThreadPoolExecutor(LOOKS) as pool:
            out |= {change[0]: entry for change, entry in zip(changes, pool.map(look, changes), strict=True) if entry}
        self.seen, self.asked = seen, True
        return dict(sorted(out.items()))  # offsets are compared as texts

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        parts = []
        moved = {e["id"]: e["byte"] for path, e in start.items() if end.get(path, {}).get("id") != e["id"]}
        for path, now in end.items():
            before = start.get(path)
            if before and before["id"] == now["id"]:
                first = before["byte"] if before["byte"] <= now["byte"] else 0
            else:
                first = moved.get(now["id"], 0)
                first = first if first <= now["byte"] else 0
            parts += [Part(path, now["id"], first, b, min(b + self.part, now["byte"])) for b in range(first, now["byte"], self.part)]
        return bundled(parts, self.part)

    def read(self, bundle: Parts) -> Iterator[pa.RecordBatch]:
        for part in bundle.parts:
            yield from self.read_part(part)

    def read_part(self, part: Part) -> Iterator[pa.RecordBatch]:
        """A file that is another one by now has nothing left to give."""
        fs, _ = file_system(self.folder)
        try:
            if identity(fs, part.path) != part.file_id:
                return
            source = fs.open_input_file(part.path)
        except FileNotFoundError:
            return
        with source as f:
            at = part.begin
            if part.begin > part.first:  # the line that reaches in is another part's
                at -= 1
            f.seek(at)
            skipping = part.begin > part.first
            rest = b""
            while at < part.end or rest:
                data = f.read(CHUNK)
                buffer = rest + data
                if skipping:
                    cut = buffer.find(b"\n") + 1
                    if not cut:
                        if not data:
                            return
                        at += len(buffer)
                        continue
                    at, buffer, skipping = at + cut, buffer[cut:], False
                *lines, rest = buffer.split(b"\n")
                places, texts = [], []
                for line in lines:
                    if at >= part.end:
                        rest = b""
                        break
                    places.append(at)
                    texts.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                if texts:
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([part.file_id] * n), pa.array(places, pa.int64()), pa.array(texts)], ["path", "file_id", "byte", "line"])
                if not data or at >= part.end:
                    return


class TailSource(DataSource):
    """Options: path; suffix of the files to read; minIdleSeconds a file must have been left alone; partBytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def write_files(lines, folder: str):
    """Writes rows (file, place, line) as one file of lines for each name `file`, in order of place, each by one task; gives file, lines and bytes of each. A null line is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        of, out, done, made = None, None, [], set()
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != of:
                    if out:
                        out.close()
                    if (folder_of := os.path.dirname(f"{root}/{name}")) not in made:
                        fs.create_dir(folder_of, recursive=True)
                        made.add(folder_of)
                    of, out = name, fs.open_output_stream(f"{root}/{name}")
                    done.append([name, 0, 0])
                data = line.encode() + b"\n"
                out.write(data)
                done[-1][1] += 1
                done[-1][2] += len(data)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "lines", "bytes"])

    rows = lines.filter("line IS NOT NULL").repartition("file").sortWithinPartitions("file", "place").select("file", "line")
    return rows.mapInArrow(run, "file string, lines bigint, bytes bigint")
