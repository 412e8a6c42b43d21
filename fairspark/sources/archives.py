"""Files restored from a source that may break off, and from archives, each checked before it counts."""

from __future__ import annotations

import hashlib
import os
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

_PIECE = 1 << 20


def crc_of(path: Path) -> int:
    value = 0
    with path.open("rb") as f:
        while piece := f.read(_PIECE):
            value = zlib.crc32(piece, value)
    return value


def fetch(read_from: Callable[[int], Iterator[bytes]], target: str | Path, size: int, sha256: str) -> int:
    """Brings a file of known size and hash to its place and returns how many bytes that took.

    read_from(offset) gives the source's bytes from an offset on. What an earlier attempt left beside the target is kept and
    continued; a target that is there with the right hash costs nothing. A wrong size or hash removes the part and is an error.
    """
    target, part, taken = Path(target), Path(f"{target}.part"), 0
    if target.exists():
        if hashlib.sha256(target.read_bytes()).hexdigest() == sha256:
            return 0
        raise ValueError(f"{target} is there with other bytes")
    target.parent.mkdir(parents=True, exist_ok=True)
    begun = part.stat().st_size if part.exists() else 0
    if begun > size:
        part.unlink()
        begun = 0
    with part.open("ab") as f:
        for piece in read_from(begun) if begun < size else ():
            f.write(piece)
            taken += len(piece)
    if part.stat().st_size < size:
        raise ConnectionError(f"{target} breaks off at {part.stat().st_size} of {size} bytes; the next attempt goes on from there")
    if part.stat().st_size != size or hashlib.sha256(part.read_bytes()).hexdigest() != sha256:
        part.unlink()
        raise ValueError(f"{target} differs from its hash")
    os.replace(part, target)
    return taken


def extract(archive: str | Path, folder: str | Path) -> list[tuple[str, int, int, bool]]:
    """(name, bytes, crc, written) of each file of a ZIP archive, in its place below the folder with the checksum that the
    archive states. Files that are there and agree are left; names that lead out of the folder are refused."""
    folder, out = Path(folder).resolve(), []
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            target = (folder / info.filename).resolve()
            if folder not in target.parents:
                raise ValueError(f"{info.filename} leads out of the folder")
            there = target.exists() and target.stat().st_size == info.file_size and crc_of(target) == info.CRC
            if not there:
                target.parent.mkdir(parents=True, exist_ok=True)
                part = Path(f"{target}.part")
                with z.open(info) as f, part.open("wb") as g:  # the archive's reader checks the sum, too
                    while piece := f.read(_PIECE):
                        g.write(piece)
                if crc_of(part) != info.CRC:
                    raise ValueError(f"{info.filename} differs from its checksum")
                os.replace(part, target)
            out.append((info.filename, info.file_size, info.CRC, not there))
    return out
