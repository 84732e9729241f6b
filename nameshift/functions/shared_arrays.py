"""Arrays in files of the folder that all executors share: written once by a task, then mapped, so that only what is looked up is read."""

from __future__ import annotations

import json
import mmap
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs

#: Tokens that a task counts, and pairs that it holds, at once.
CHUNK = 1 << 20
_ALIGN = 64
_open: dict[str, dict[str, np.ndarray]] = {}


def open_at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI; a plain path, or ``file:/`` with any number of slashes, is local."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_parts(folder: str, parts: list[bytes | np.ndarray]) -> tuple[str, list[int]]:
    """A new file whose name no other attempt of the task shares, and where its parts begin."""
    uri, begins, at = f"{folder}/{uuid.uuid4().hex}", [], 0
    store, path = open_at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        for part in parts:
            data = memoryview(part).cast("B") if len(part) else b""
            begins.append(at)
            out.write(data)
            fill = -len(data) % _ALIGN
            out.write(bytes(fill))
            at += len(data) + fill
    return uri, begins


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """A file that ``arrays`` reads; returns where it is and what it holds, as one text."""
    arrays = {name: np.ascontiguousarray(a) for name, a in arrays.items()}
    uri, begins = write_parts(folder, list(arrays.values()))
    return json.dumps([uri, [[name, a.dtype.str, begin, len(a)] for (name, a), begin in zip(arrays.items(), begins, strict=True)]])


def _buffer(uri: str):
    store, path = open_at(uri)
    if not isinstance(store, fs.LocalFileSystem):
        return store.open_input_file(path).read()
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)


def arrays(place: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped once per process."""
    if place not in _open:
        uri, names = json.loads(place)
        data = _buffer(uri) if any(n for *_, n in names) else b""
        _open[place] = {name: np.frombuffer(data, kind, n, begin) if n else np.zeros(0, kind) for name, kind, begin, n in names}
    return _open[place]


def forget() -> None:
    """A new model is made: files of earlier ones are mapped again if anything asks for them."""
    _open.clear()
    pa.default_memory_pool().release_unused()


def deal(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each value of ``part``, of which there are ``n``."""
    order = np.argsort(part.astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")
    ends = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(ends)):
        yield int(p), order[ends[p] : ends[p + 1]]


def _packed(columns: list[np.ndarray]) -> bytes:
    """32-bit numbers, byte planes apart, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes, n_columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return [np.zeros(0, np.int32)] * n_columns
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n * n_columns, "zstd"), np.uint8).reshape(n_columns, 4, n)
    return [np.ascontiguousarray(p.T).view(np.int32).ravel() for p in planes]


def write_dealt(folder: str, n: int, part: np.ndarray, columns: list[np.ndarray]) -> str:
    """Rows dealt to ``n`` receivers by ``part``, in their order: one file, in which each receiver finds its rows."""
    found = dict(deal(part, n))
    none = np.zeros(0, np.int64)
    blobs = [_packed([c[found.get(p, none)] for c in columns]) for p in range(n)]
    ends = np.cumsum([8 * (n + 1), *map(len, blobs)]).astype(np.int64)
    return write_parts(folder, [ends.tobytes() + b"".join(blobs)])[0]


def read_dealt(uris: list[str], p: int, n_columns: int) -> list[np.ndarray]:
    """The rows that all files hold for receiver ``p``."""
    found = [[np.zeros(0, np.int32)] * n_columns]
    for uri in uris:
        store, path = open_at(uri)
        with store.open_input_file(path) as f:
            begin, end = np.frombuffer(f.read_at(16, 8 * p), np.int64)
            found.append(_unpacked(f.read_at(int(end - begin), int(begin)), n_columns))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def drop_files(uris: list[str]) -> None:
    """Files that no later step reads."""
    for uri in uris:
        store, path = open_at(uri)
        store.delete_file(path)


def slices(lists: pa.Array, most: int = CHUNK) -> Iterator[pa.Array]:
    """Rows of lists in parts of a bounded number of entries, one row at least."""
    ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64))
    begin = 0
    while begin < len(lists):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lists.slice(begin, end - begin)
        begin = end
