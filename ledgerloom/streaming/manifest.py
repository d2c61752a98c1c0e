"""Versions of a stored table: small text files that name the live folders.

A version is a file ``_manifest/<number>`` with one JSON object per line, put in place by a rename. Writers put data in
new folders first and name them last, so a reader sees a version whole or not at all, and a writer that died leaves
folders that nothing names. The lines count folders, not rows.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

KEPT_VERSIONS = 4


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    fs, place = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def folders(spark: SparkSession, path: str, *columns: str) -> list[list[str]]:
    """Values of the partition folders below a path, one list for each leaf folder."""
    fs, place = _fs(spark, "/".join([path, *(f"{c}=*" for c in columns)]))
    found = fs.globStatus(place) or []
    return [[part.split("=", 1)[1] for part in s.getPath().toString().split("/")[-len(columns) :]] for s in found]


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place; a reader finds the old one, none, or all of the new one."""
    fs, place = _fs(spark, path)
    _, fresh = _fs(spark, f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.new")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(place, False)
    if not fs.rename(fresh, place):
        raise OSError(f"could not put {path} in place")


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _fs(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in names(spark, f"{root}/_manifest") if n.isdigit()]


def live(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, list[dict]]:
    """(number, entries) of the newest version, or of the newest below ``before``; (-1, []) if there is none."""
    found = [v for v in versions(spark, root) if before is None or v < before]
    if not found:
        return -1, []
    text = read_text(spark, f"{root}/_manifest/{max(found):020d}")
    return max(found), [json.loads(line) for line in text.splitlines()]


def commit(spark: SparkSession, root: str, version: int, entries: list[dict]) -> None:
    """Make a version live. Later versions, left by a run that is being repeated, go; so do long superseded ones."""
    write_text(spark, f"{root}/_manifest/{version:020d}", "".join(json.dumps(e, sort_keys=True) + "\n" for e in entries))
    found = versions(spark, root)
    for v in [v for v in found if v > version] + [v for v in found if v <= version][:-KEPT_VERSIONS]:
        delete(spark, f"{root}/_manifest/{v:020d}")
