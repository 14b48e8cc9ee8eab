"""Small files and folder listings through Spark's own file systems, so that a
path may be any Hadoop URI."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commit_text(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Write a file that appears whole or not at all. False if there is one of
    that name already, which stays as it is: of two writers one wins."""
    fs, target = _open(spark, f"{folder}/{name}")
    target = fs.makeQualified(target)
    tmp = fs.makeQualified(_open(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")[1])
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    strict = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(tmp, target, strict)
        return True
    except Exception:
        if not fs.exists(target):
            raise
        fs.delete(tmp, False)
        return False


def state(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the files below the paths: names, sizes and times. Equal
    digests mean unchanged tables."""
    seen = []
    for path in paths:
        fs, p = _open(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath().toUri().getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()
