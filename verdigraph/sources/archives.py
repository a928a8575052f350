"""Archives and formats: what a path holds, and where its data are."""

from __future__ import annotations

import gzip
import lzma
import shutil
import tarfile
import zipfile
from pathlib import Path

# The first bytes of archive formats.
_MAGIC = ((b"PK\x03\x04", "zip"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"\x1f\x8b", "gz"), (b"\xfd7zXZ\x00", "xz"))


def archive_format(head: bytes) -> str:
    """zip, 7z, gz, xz, or plain."""
    return next((name for magic, name in _MAGIC if head.startswith(magic)), "plain")


def _inside(folder: Path, name: str) -> Path:
    target = (folder / name).resolve()
    if not target.is_relative_to(folder.resolve()):
        raise ValueError(f"{name!r} leaves the archive")
    return target


def extract(path: Path) -> Path:
    """The folder beside the archive with its files, unpacked once; the path itself where it is no archive."""
    with path.open("rb") as f:
        kind = archive_format(f.read(8))
    if kind == "plain":
        return path
    folder = path.with_name(path.name + ".d")
    if folder.is_dir():
        return folder
    part = folder.with_name(folder.name + ".part")
    shutil.rmtree(part, ignore_errors=True)
    part.mkdir()
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                _inside(part, name)
            z.extractall(part)
    elif kind == "7z":
        tool = shutil.which("7z") or shutil.which("7za")
        if tool is None:
            raise ValueError("no tool for 7z archives is installed")
        import subprocess

        subprocess.run([tool, "x", "-y", f"-o{part}", str(path)], check=True, capture_output=True)
    elif tarfile.is_tarfile(path):
        with tarfile.open(path) as t:
            t.extractall(part, filter="data")
    else:
        with (gzip.open if kind == "gz" else lzma.open)(path) as source, (part / path.stem).open("wb") as out:
            shutil.copyfileobj(source, out)
    part.rename(folder)
    return folder


def data_format(path: Path) -> str | None:
    """ecospold2, ecospold1, simapro, ilcd or None, by names and by what the first file says."""
    if path.is_dir():
        if any(p.is_dir() and p.name.lower() == "processes" for p in path.rglob("*")):
            return "ilcd"
        for suffix in (".spold", ".xml", ".csv"):
            for p in sorted(path.rglob("*")):
                if p.suffix.lower() == suffix and (found := data_format(p)):
                    return found
        return None
    if path.suffix.lower() == ".spold":
        return "ecospold2"
    with path.open("rb") as f:
        head = f.read(4096)
    if path.suffix.lower() == ".csv":
        return "simapro" if head.lstrip(b"\xef\xbb\xbf").startswith(b"{") else None
    return "ecospold1" if path.suffix.lower() == ".xml" and b"EcoSpold01" in head else None
