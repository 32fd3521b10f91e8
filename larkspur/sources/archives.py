"""Packed skills: deterministic archives written, and archives expanded under safety limits."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST_BYTES, MOST_FILES, LONGEST_PATH = 20 << 20, 200, 255


def safe_path(path: str) -> bool:
    return bool(path) and not path.startswith("/") and "\\" not in path and len(path.encode()) <= LONGEST_PATH and all(p not in ("", ".", "..") for p in path.split("/"))


def pack(files: dict[str, bytes]) -> bytes:
    """The same bytes for the same files, whatever the day."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for path in sorted(files, key=str.encode):
            info = tarfile.TarInfo(path)
            info.size, info.mode = len(files[path]), 0o644
            tar.addfile(info, io.BytesIO(files[path]))
    return gzip.compress(raw.getvalue(), mtime=0)


def unpack(data: bytes) -> list[tuple[str, bytes]]:
    """Files of an archive; ValueError where a limit or path rule is broken."""
    out, total = [], 0
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
        for member in tar:
            if member.isdir():
                continue
            if not member.isfile() or not safe_path(member.name):
                raise ValueError(f"unsafe entry {member.name!r}")
            total += member.size
            if len(out) >= MOST_FILES or total > MOST_BYTES:
                raise ValueError("archive is too large")
            out.append((member.name, tar.extractfile(member).read()))
    return out


def expand(archives: DataFrame) -> DataFrame:
    """archive, path, content, error of archives (path, content as in binaryFile)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(name, p, c, None) for p, c in unpack(bytes(data))]
                except (ValueError, OSError, tarfile.TarError, EOFError) as error:
                    rows = [(name, None, None, str(error))]
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "error"])

    return archives.select("path", "content").mapInPandas(work, "archive string, path string, content binary, error string")
