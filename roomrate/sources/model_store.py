"""Fitted-model storage that never overwrites.

The first save of a model family goes to `<dir>/<family>_default`; once that
exists, later saves go to `<dir>/<family>_<yyyymmdd_HHMMSS>` (a counter is
appended if that exists too). The folder is the shared checkpoint folder
unless the caller names another shared location.

A model is written aside first. Its name is then claimed by creating `<name>.claim`, which one of several jobs can do, and
the whole folder is renamed to it: jobs that save at once get names of their own, and a reader never sees half a model.
Stored tables and models of a key are kept by the state of their input files too, so changed input is worked out anew.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from roomrate.operators.models import GroupedForest
from roomrate.operators.vectors import vector_schema
from roomrate.session import shared_path


def _located(spark: SparkSession, path: str):
    """(file system, path) of a path, as Spark sees it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _located(spark, path)
    return fs.exists(hpath)


def claimed(spark: SparkSession, path: str) -> bool:
    """Create the empty file `path`, unless it is there: of several jobs, one gets True. Distributed file systems create
    exclusively; a local one is asked for it by the flag that does so."""
    fs, hpath = _located(spark, path)
    fs.mkdirs(hpath.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            os.close(os.open(hpath.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(hpath, False).close()
        return True
    except Exception:
        if fs.exists(hpath):
            return False
        raise


def published(spark: SparkSession, aside: str, path: str) -> bool:
    """Give the finished folder `aside` the name `path`, if the name is free."""
    if _exists(spark, path) or not claimed(spark, path + ".claim"):
        return False
    fs, source = _located(spark, aside)
    if not fs.rename(source, _located(spark, path)[1]):
        raise OSError(f"cannot rename {aside} to {path}")
    return True


def choose_model_path(spark: SparkSession, family: str, folder: str | None = None) -> str:
    folder = folder or shared_path(spark, "models", unique=False)
    default = f"{folder.rstrip('/')}/{family}_default"
    if not _exists(spark, default):
        return default
    stamp = time.strftime("%Y%m%d_%H%M%S")
    candidate, n = f"{folder.rstrip('/')}/{family}_{stamp}", 1
    while _exists(spark, candidate):
        candidate, n = f"{folder.rstrip('/')}/{family}_{stamp}_{n}", n + 1
    return candidate


def save_model(spark: SparkSession, model: PipelineModel, family: str, folder: str | None = None) -> str:
    """Write the model aside, then publish it under the first free name."""
    folder = folder or shared_path(spark, "models", unique=False)
    aside = f"{folder.rstrip('/')}/_aside/{uuid.uuid4().hex}"
    model.write().save(aside)
    path, n = choose_model_path(spark, family, folder), 0
    while not published(spark, aside, path):  # another job was faster, or has claimed the name and not published yet
        n += 1
        path = f"{folder.rstrip('/')}/{family}_{time.strftime('%Y%m%d_%H%M%S')}_{n}"
    return path


def input_stamp(spark: SparkSession, folder: str) -> str:
    """Digest of the names, lengths and times of the files under a folder."""
    fs, hpath = _located(spark, folder)
    files, found = fs.listFiles(hpath, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _keyed_path(spark: SparkSession, kind: str, key: str, source: str) -> str:
    """A path that this application, key and state of the input files always give (the shared folder is the
    application's own)."""
    stamp = f"{key}:{source}:{input_stamp(spark, source)}"
    return shared_path(spark, kind, hashlib.sha256(stamp.encode()).hexdigest()[:24], unique=False)


def stored_table(spark: SparkSession, key: str, source: str, build: Callable[[], DataFrame], vectors: tuple[str, ...] = ()) -> DataFrame:
    """The Parquet table of a key over the input files under `source`, written on first use; its columns `vectors` (structs
    of a vector's fields) are read as vectors."""
    path = _keyed_path(spark, "tables", key, source)
    if not _exists(spark, path + "/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    return spark.read.schema(vector_schema(table.schema, vectors)).parquet(path) if vectors else table


def stored_model(spark: SparkSession, key: str, source: str,
                 fit: Callable[[], PipelineModel | GroupedForest]) -> PipelineModel | GroupedForest:
    """The saved model of a key over the input files under `source`, fitted on first use; always the loaded one, so that the
    first use and later ones score alike."""
    path = _keyed_path(spark, "fitted", key, source)
    if not _exists(spark, path + "/metadata/_SUCCESS") and not _exists(spark, path + "/groups/_SUCCESS"):
        model = fit()
        if isinstance(model, GroupedForest):
            model.save(path)
        else:
            model.write().overwrite().save(path)
    return GroupedForest.load(spark, path) if _exists(spark, path + "/groups/_SUCCESS") else load_model(path)
