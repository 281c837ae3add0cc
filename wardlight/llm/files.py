"""Binary files in the shared folder, written and range-read by tasks."""

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """URI of a new folder below the cluster's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """The filesystem of a URI (file, hdfs, s3, gs) or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """Output stream of a new file; folders above it are made."""
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def open_range(uri: str):
    """Random-access input of a file."""
    store, path = filesystem(uri)
    return store.open_input_file(path)


def one_task_each(manifest: DataFrame) -> DataFrame:
    """Spread a small table of files so that each row is a task of its own."""
    return manifest.repartition(max(1, manifest.count()))
