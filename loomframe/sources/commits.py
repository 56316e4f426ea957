"""An append log of numbered commits: small JSON entries whose numbers have no gaps and one writer each."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, folder: str):
    """(path, file system) of a folder in any store that Spark opens."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _name(number: int) -> str:
    return f"{number:010d}.json"


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The commits' numbers in order; a folder that isn't there has none."""
    path, files = _open(spark, folder)
    if not files.exists(path):
        return []
    names = (s.getPath().getName() for s in files.listStatus(path))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def entry(spark: SparkSession, folder: str, number: int) -> dict:
    path, files = _open(spark, f"{folder}/{_name(number)}")
    stream = files.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def read(spark: SparkSession, folder: str) -> list[tuple[int, dict]]:
    """(number, entry) in order. The log holds an entry a commit, not rows."""
    return [(n, entry(spark, folder, n)) for n in numbers(spark, folder)]


def _put(spark: SparkSession, folder: str, number: int, body: dict) -> bool:
    """Whether the body is now commit `number`; False where another writer has it. The entry appears whole or not."""
    path, files = _open(spark, folder)
    files.mkdirs(path)
    path = files.makeQualified(path)
    text = json.dumps(body, sort_keys=True)
    if files.getUri().getScheme() == "file":
        base = path.toUri().getPath()
        draft = f"{base}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, f"{base}/{_name(number)}")  # fails where the name is taken
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    return _rename(spark, path, number, text)


def _rename(spark: SparkSession, path, number: int, text: str) -> bool:
    """By a rename that doesn't replace, which stores of this interface make atomic."""
    jvm = spark._jvm
    kinds = jvm.org.apache.hadoop.fs
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = kinds.Path(path, f".{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark._sc._gateway.new_array(getattr(kinds, "Options$Rename"), 0)
    try:
        kinds.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, kinds.Path(path, _name(number)), options)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    return True


def append(spark: SparkSession, folder: str, body: dict, number: int | None = None) -> int:
    """Add an entry and return its number: the last one and one, tried again while other writers are faster.

    With a number, the entry is that commit or an error: for writers whose entry holds only after the commits they read.
    """
    while True:
        own = (numbers(spark, folder) or [0])[-1] + 1 if number is None else number
        if _put(spark, folder, own, body):
            return own
        if number is not None:
            raise FileExistsError(f"commit {number} of {folder} is taken")
