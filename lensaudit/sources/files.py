"""Files by path or URI. A path without a scheme is one of the local (or mounted) file system, anything else goes through Spark's file systems."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import SparkSession


def is_uri(path: str) -> bool:
    return "://" in path


def uri(path: str) -> str:
    return path if is_uri(path) else f"file://{path}"


def normal(path: str) -> str:
    """Without `.`, `..` and, where a path can be followed, links."""
    if not is_uri(path):
        return os.path.realpath(path)
    scheme, rest = path.split("://", 1)
    host, _, below = rest.partition("/")
    return f"{scheme}://{host}{os.path.normpath('/' + below)}"


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    if not is_uri(path):
        return os.path.isdir(path) if folder else os.path.exists(path)
    system, at = _system(spark, path)
    return system.exists(at) and (not folder or system.getFileStatus(at).isDirectory())


def reachable(scheme: str) -> bool:
    """Whether a task can open files of a scheme without Spark: no scheme is the local or mounted file system."""
    return scheme in ("", "file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def _arrow(uri_: str):
    """Arrow's file system for a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri_)


def sizes(paths: list[str]) -> list[int | None]:
    """Bytes of each file, None for what doesn't exist or isn't a file. For tasks: needs no session."""
    out: list[int | None] = []
    for path in paths:
        try:
            if is_uri(path):
                system, at = _arrow(path)
                info = system.get_file_info(at)
                out.append(info.size if info.is_file else None)
            else:
                out.append(os.path.getsize(path) if os.path.isfile(path) else None)
        except OSError:
            out.append(None)
    return out


def opened(path: str) -> bytes:
    """A file's bytes. For tasks: needs no session."""
    if not is_uri(path):
        return Path(path).read_bytes()
    system, at = _arrow(path)
    with system.open_input_stream(at) as stream:
        return stream.read()


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, with the folders above it."""
    if not is_uri(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_bytes(data)
        return
    system, at = _system(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _number(name: str) -> tuple[int, str]:
    """Orders part files by the task that wrote them, however many digits its number has."""
    return int(name.split("-")[1]), name


def join_parts(spark: SparkSession, folder: str, path: str, head: bytes) -> None:
    """head and all part files of a written folder, byte by byte in the order of their tasks, as one file at path; deletes the folder.

    The driver passes bytes on by the megabyte and holds no part. path has the whole file or what it had before, where the file system renames in one step.
    """
    if not is_uri(folder):
        parts = sorted((p.name for p in Path(folder).glob("part-*")), key=_number)
        whole = Path(folder) / "whole"
        with open(whole, "wb") as out:
            out.write(head)
            for name in parts:
                with open(Path(folder) / name, "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 20)
        os.replace(whole, path)
        shutil.rmtree(folder)
        return
    system, at = _system(spark, folder)
    parts = sorted((s.getPath().getName() for s in system.listStatus(at) if s.getPath().getName().startswith("part-")), key=_number)
    whole, target = spark._jvm.org.apache.hadoop.fs.Path(at, "whole"), spark._jvm.org.apache.hadoop.fs.Path(path)
    out = system.create(whole, True)
    try:
        out.write(bytearray(head))
        for name in parts:
            part = system.open(spark._jvm.org.apache.hadoop.fs.Path(at, name))
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    system.delete(target, True)
    if not system.rename(whole, target):
        raise OSError(f"{whole.toString()} can't be moved to {path}")
    system.delete(at, True)
