"""Small files of an index: on the local file system for plain paths, through Spark's file systems for URLs (hdfs://, s3a://, file:// ...)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def is_url(path: str) -> bool:
    return "://" in path


def joined(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *names])


def for_spark(path: str) -> str:
    """The path as Spark must be told it, whatever its default file system."""
    return path if is_url(path) else Path(path).absolute().as_uri()


def _system(path: str):
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, spark._jsc.hadoopConfiguration(), at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    if not is_url(path):
        return Path(path).exists()
    _, _, at, system = _system(path)
    return system.exists(at)


def read_text(path: str) -> str:
    if not is_url(path):
        return Path(path).read_text()
    jvm, _, at, system = _system(path)
    stream = system.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    if not is_url(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return
    _, _, at, system = _system(path)
    stream = system.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def replace(source: str, target: str) -> None:
    """Renames over the target in one step, as far as the file system can."""
    if not is_url(source):
        os.replace(source, target)
        return
    jvm, conf, at, _ = _system(source)
    over = SparkSession.active().sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(at, jvm.org.apache.hadoop.fs.Path(target), over)


def names(folder: str) -> list[str]:
    if not is_url(folder):
        return [p.name for p in Path(folder).iterdir()] if Path(folder).exists() else []
    _, _, at, system = _system(folder)
    return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []


def size(folder: str) -> int:
    """Bytes of all files below."""
    if not is_url(folder):
        return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())
    _, _, at, system = _system(folder)
    return system.getContentSummary(at).getLength()
