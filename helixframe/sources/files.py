"""Opening and listing of files by name: plain, gzip (also of several members) and bzip2."""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import os
import sys
from typing import BinaryIO

from pyarrow import fs


def open_binary(path: str) -> BinaryIO:
    """A buffered byte stream, decompressed by extension; URIs go through Arrow's file systems, and "-"
    is the standard input (of the driver: its partition is read where the process runs)."""
    if path == "-":
        return sys.stdin.buffer
    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path)
        raw: BinaryIO = io.BufferedReader(store.open_input_stream(inner, compression=None))
    else:
        raw = open(path, "rb", buffering=1 << 20)  # noqa: SIM115
    if path.endswith((".gz", ".bgz", ".bam")):
        return gzip.GzipFile(fileobj=raw)
    return bz2.BZ2File(raw) if path.endswith(".bz2") else raw


def open_plain(path: str) -> BinaryIO:
    """The bytes of a file as they are, seekable."""
    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path, "rb")  # noqa: SIM115


def expand(paths: str) -> list[str]:
    """Files of a comma-separated list of names, folders and patterns, in order."""
    out: list[str] = []
    for p in filter(None, (x.strip() for x in paths.split(","))):
        if "://" in p or p.startswith("file:"):
            store, inner = fs.FileSystem.from_uri(p)
            info = store.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                found = store.get_file_info(fs.FileSelector(inner))
                out += sorted(p.rstrip("/") + "/" + x.base_name for x in found if not x.base_name.startswith((".", "_")))
            else:
                out.append(p)
        elif p == "-":
            out.append(p)
        elif os.path.isdir(p):
            out += sorted(os.path.join(p, x) for x in os.listdir(p) if not x.startswith((".", "_")))
        else:
            out += sorted(glob.glob(p)) or [p]
    return out
