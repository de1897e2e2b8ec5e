"""One file from many tasks: pieces are written where they belong in a file that all executors see, and the file gets its name last."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager


def local_path(path: str) -> str:
    """The path below which executors write: a shared POSIX folder, plain or as file:; other file systems can't write in the middle of a file."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} isn't in a shared POSIX folder, where tasks could write parts of one file")
    return os.path.abspath(path)


@contextmanager
def committed(path: str) -> Iterator[str]:
    """A name for the unfinished file or folder, renamed to ``path`` if all goes well and deleted if not. ``path`` must not be there."""
    target = local_path(path)
    if os.path.exists(target):
        raise ValueError(f"{path} is there already")
    unfinished = f"{target}.unfinished-{uuid.uuid4().hex}"
    try:
        yield unfinished
        os.rename(unfinished, target)
    finally:
        if os.path.isdir(unfinished):
            shutil.rmtree(unfinished)
        elif os.path.exists(unfinished):
            os.remove(unfinished)


def write_at(path: str, pieces: Iterable[tuple[int, bytes]]) -> int:
    """Bytes written at their offsets into a file that is there already. A task that is run again, or twice at once, writes the same bytes at
    the same places; one that outlives the commit finds no file and fails without harm."""
    done = 0
    with open(path, "r+b") as out:
        for offset, piece in pieces:
            out.seek(offset)
            out.write(piece)
            done += len(piece)
        out.flush()
        os.fsync(out.fileno())
    return done


def runs(pieces: Iterable[tuple[int, bytes]], most: int = 4_000_000) -> Iterator[tuple[int, bytes]]:
    """Pieces that follow each other put together, up to ``most`` bytes at once."""
    start, held, size = 0, [], 0
    for offset, piece in pieces:
        if held and (offset != start + size or size >= most):
            yield start, b"".join(held)
            held, size = [], 0
        if not held:
            start = offset
        held.append(piece)
        size += len(piece)
    if held:
        yield start, b"".join(held)


def times_x(a: int, n: int, polynomial: int = 0xEDB88320) -> int:
    """a * x^n in CRC-32's field, bits reversed as CRC-32 keeps them."""

    def times(u: int, v: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if u >> bit & 1:
                out ^= v
            v = v >> 1 ^ (polynomial if v & 1 else 0)
        return out

    power, step = 1 << 31, 1 << 30  # 1 and x
    while n:
        if n & 1:
            power = times(power, step)
        step, n = times(step, step), n >> 1
    return times(a, power)


def joined_crc(parts: Iterable[tuple[int, int]], shifted: Callable[[int, int], int] = times_x) -> tuple[int, int]:
    """CRC-32 and length of (crc, length) parts one after the other, without their bytes."""
    crc = size = 0
    for part, length in parts:
        crc, size = shifted(crc, 8 * length) ^ part, size + length
    return crc, size
