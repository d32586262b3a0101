"""A source of the lines of growing files, which Spark's own file source takes as immutable; for batches and for streams.

The driver asks for each file's size, time and identity, and opens those that changed since it last did, for their last newline. Ranges of
bytes between two such looks are read on the executors, large files in several. Files have one path on all machines (a mounted folder, say).
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

HEAD = 4096
#: Bytes of one file that one task reads, about; and that are read at a time. A longer line makes either grow.
SPLIT, WINDOW = 32 << 20, 1 << 20
_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fingerprint(head: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = _BASIS
    for b in head[:HEAD]:
        h = ((h ^ b) * _PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def resume(size: int, head: bytes, identity: str | None, cursor: dict | None) -> tuple[int, str]:
    """(offset to read from, continuity) of a file against where we stopped.

    A smaller file is `truncated`; another identity is `replaced`, or without identities another fingerprint of
    the bytes that were there; otherwise it was `appended`.
    """
    if cursor is None:
        return 0, "appended"
    if size < cursor["offset"]:
        return 0, "truncated"
    if identity and cursor.get("identity"):
        return (cursor["offset"], "appended") if identity == cursor["identity"] else (0, "replaced")
    if cursor.get("fingerprint") is not None and fingerprint(head[: min(HEAD, cursor.get("head", HEAD))]) != cursor["fingerprint"]:
        return 0, "replaced"
    return cursor["offset"], "appended"


def whole_lines(data: bytes, offset: int) -> tuple[list[tuple[int, str]], int]:
    """(offset, line) of each terminated line, and the offset after the last; a partial line is withheld."""
    out, at = [], 0
    while (end := data.find(b"\n", at)) >= 0:
        line = data[at:end].removesuffix(b"\r")
        if line:
            out.append((offset + at, line.decode("utf-8", "replace")))
        at = end + 1
    return out, offset + at


def last_newline(f, size: int) -> int:
    """The offset after the last newline before size, looked for from the end."""
    end, window = size, WINDOW
    while end > 0:
        begin = max(0, end - window)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end, window = begin, 2 * window
    return 0


def look(path: str, identify=None) -> dict | None:
    """A file's cursor as of now: offset (after its last whole line), size, identity, fingerprint of its first bytes; None if it is gone."""
    try:
        with open(path, "rb") as f:
            stat = os.fstat(f.fileno())
            identity = f"{stat.st_dev}:{stat.st_ino}" if identify is None else identify(path)
            end = last_newline(f, stat.st_size)
            f.seek(0)
            head = f.read(min(HEAD, end))
    except FileNotFoundError:
        return None
    return {"offset": end, "size": stat.st_size, "mtime": stat.st_mtime_ns, "identity": identity, "fingerprint": fingerprint(head), "head": len(head)}


def begin_at(path: str, cursor: dict | None, now: dict) -> tuple[int, str]:
    """(offset to read from, continuity) of a file against where we stopped."""
    head = b""
    if cursor is not None and not (now["identity"] and cursor.get("identity")):
        try:
            with open(path, "rb") as f:
                head = f.read(HEAD)
        except FileNotFoundError:
            pass
    return resume(now.get("size", now["offset"]), head, now["identity"], cursor)


def read_range(path: str, start: int, stop: int, first: bool = True) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin in a range of bytes, to their ends. Unless `first`, the range may begin inside a line, which is not its own.

    A file that is gone meanwhile has no lines. Windows are read one after another, so memory holds one of them and one line.
    """
    try:
        f = open(path, "rb")
    except FileNotFoundError:
        return
    with f:
        at = start
        if not first:  # the line that holds the byte before the range belongs to the range before
            f.seek(start - 1)
            at = start - 1
            while True:
                part = f.readline(WINDOW)
                at += len(part)
                if not part or part.endswith(b"\n"):
                    break
        f.seek(at)
        rest = b""
        while at < stop:
            data = f.read(WINDOW)
            if not data:
                return
            lines, end = whole_lines(rest + data, at)
            for offset, line in lines:
                if offset >= stop:
                    return
                yield offset, line
            rest = (rest + data)[end - at :]
            at = end


class Range(InputPartition):
    """Bytes of one file."""

    def __init__(self, path: str, start: int, stop: int, first: bool, continuity: str):
        super().__init__((path, start))
        self.path, self.start, self.stop, self.first, self.continuity = path, start, stop, first, continuity


def ranges(begin: dict[str, dict], end: dict[str, dict]) -> list[Range]:
    """What lies between two looks at the files, in ranges of about SPLIT bytes."""
    out = []
    for path, now in sorted(end.items()):
        start, continuity = begin_at(path, begin.get(path), now)
        for lo in range(start, now["offset"], SPLIT):
            out.append(Range(path, lo, min(lo + SPLIT, now["offset"]), lo == start, continuity))
    return out


def _as_known(path: str, cursor: dict | None) -> dict | None:
    if cursor is None:
        return None
    try:
        stat = os.stat(path)
    except FileNotFoundError:
        return None
    same = (stat.st_size, stat.st_mtime_ns, f"{stat.st_dev}:{stat.st_ino}") == (cursor.get("size"), cursor.get("mtime"), cursor["identity"])
    return cursor if same else None


#: Files of cursors that stay: Spark goes back to the last one or two of them.
KEPT_CURSORS = 20


def store_cursors(folder: str, cursors: dict[str, dict]) -> str:
    """Write cursors to a file named by its content, whole or not at all; its path."""
    text = json.dumps(cursors, sort_keys=True)
    path = os.path.join(folder, f"{hashlib.sha256(text.encode()).hexdigest()[:32]}.json")
    if os.path.exists(path):
        os.utime(path)  # it is the newest again
        return path
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w") as f:
        f.write(text)
    os.replace(part, path)
    for old in stored_cursors(folder)[:-KEPT_CURSORS]:
        os.remove(old)
    return path


def stored_cursors(folder: str) -> list[str]:
    """The files of cursors in a folder, the newest last."""
    try:
        names = [os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".json")]
    except FileNotFoundError:
        return []
    return sorted(names, key=lambda p: os.stat(p).st_mtime_ns)


def load_cursors(offset: dict | None) -> dict[str, dict]:
    """The cursors of an offset: those in it, or in the file that it names."""
    if offset and "stored" in offset:
        with open(offset["stored"]) as f:
            return json.load(f)
    return json.loads((offset or {}).get("cursors", "{}"))


class _Files:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.exclude = [x for x in options.get("exclude", "").split(os.pathsep) if x]

    def files(self) -> list[str]:
        found = []
        for top, _, names in os.walk(self.root):
            found += [os.path.join(top, n) for n in names if n.endswith(".jsonl")]
        return sorted(p for p in found if not any(p == x or p.startswith(x.rstrip("/") + "/") for x in self.exclude))

    def cursors(self, known: dict[str, dict] | None = None) -> dict[str, dict]:
        """A cursor for each file; of a file that has the size, time and identity of a known cursor, that one, without opening it."""
        looks = ((p, _as_known(p, (known or {}).get(p)) or look(p)) for p in self.files())
        return {p: x for p, x in looks if x is not None}

    def read(self, part: Range) -> Iterator[tuple]:
        for offset, line in read_range(part.path, part.start, part.stop, part.first):
            yield part.path, offset, line, part.continuity


class BatchReader(_Files, DataSourceReader):
    """Every whole line that is there."""

    def partitions(self) -> list[Range]:
        return ranges({}, self.cursors())


class TailReader(_Files, DataSourceStreamReader):
    """A batch reads all that is new, however much. Offsets are a cursor for each file, which the query's checkpoint keeps; or, with the option `cursors`, a
    folder, each names a file there with the cursors, and is as short for a million files as for one."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.folder, self.known = options.get("cursors"), None

    def initialOffset(self) -> dict:
        return {"cursors": "{}"}

    def latestOffset(self, *_) -> dict:
        if self.known is None:
            last = stored_cursors(self.folder)[-1:] if self.folder else []
            self.known = load_cursors({"stored": last[0]}) if last else {}
        self.known = self.cursors(self.known)
        return {"stored": store_cursors(self.folder, self.known)} if self.folder else {"cursors": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(load_cursors(start), load_cursors(end))


class TranscriptTail(DataSource):
    """`spark.readStream.format("transcript_tail").load(root)`, or spark.read, after `spark.dataSource.register(TranscriptTail)`."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return "path string, byte_offset long, value string, continuity string"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)
