"""Versioned manifests: small JSON files in a shared folder, each naming what belongs to one version of a table or batch. A version is there once its manifest is; readers take the last one."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it is missing."""
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def signature(spark: SparkSession, files: list[str]) -> list[list]:
    """Path, length and time of change of each file, by path: what tells whether a source has changed."""
    out = []
    for f in sorted(files):
        fs, at = _fs(spark, f)
        s = fs.getFileStatus(at)
        out.append([f, s.getLen(), s.getModificationTime()])
    return out


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(m[1]) for n in children(spark, folder) if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """Number and content of the last manifest; 0 and None where there is none."""
    numbers = _numbers(spark, folder)
    if not numbers:
        return 0, None
    fs, at = _fs(spark, f"{folder}/manifest-{numbers[-1]}.json")
    stream = fs.open(at)
    try:
        return numbers[-1], json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Make content the manifest of that number: written aside and renamed, so that no reader sees half of it. FileExistsError where another writer has taken the number."""
    fs, target = _fs(spark, f"{folder}/manifest-{number}.json")
    _, aside = _fs(spark, f"{folder}/.writing-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise FileExistsError(f"manifest {number} of {folder} is already there")
