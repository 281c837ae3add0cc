"""Session settings for local runs; a cluster brings its own session."""

import contextlib
import contextvars
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "wardlight") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.logging.maxLines", "0")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's, or a local one where unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Removes the shuffle files of a statement when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files that a task of ``stored_by`` holds open; up to these folders it need not sort, and spill, its rows.
_OPEN_FILES = ("spark.sql.maxConcurrentOutputFileWriters", "16")
#: Folders of the open scopes, innermost last.
_scopes: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes within this scope are removed at its end.

    A result that is returned out of the scope must read only tables stored with ``keep``, which belong to the
    scope around it (to the application, where there is none).
    """
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    token = _scopes.set((*_scopes.get(), folder))
    try:
        yield
    finally:
        _scopes.reset(token)
        remove(folder)


def remove(uri: str) -> None:
    """Delete a folder below the shared folder, if it is there."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(uri)
    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)


def stored(df: DataFrame, keep: bool = False, folder: str | None = None) -> DataFrame:
    """Write a small intermediate table to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read, and gives later
    joins the true size of the table. The shuffle files of the steps before go when it is
    written, the table itself at the end of the scope (``scratch``), with ``keep`` of the scope around; in a
    ``folder`` of the caller's it stays.
    """
    path = folder or _new_place(df.sparkSession, keep)
    with _shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite" if folder else "error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str, keep: bool = False, folder: str | None = None) -> DataFrame:
    """``stored`` with a folder for each value of ``column``, so that readers open only those they ask for."""
    path = folder or _new_place(df.sparkSession, keep)
    with _shuffles_dropped(df.sparkSession), open_files(df.sparkSession):
        df.write.partitionBy(column).mode("overwrite" if folder else "error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _new_place(spark: SparkSession, keep: bool) -> str:
    scopes = _scopes.get()
    above = scopes[:-1] if keep else scopes
    return f"{(above[-1] if above else shared_folder(spark)).rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    return _setting(spark, _DROP_SHUFFLES, "true")


def open_files(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Tasks that write several folders hold their files open instead of sorting their rows, within this scope."""
    return _setting(spark, *_OPEN_FILES)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per application, so that Python kernels can import it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    from pyarrow import fs

    home, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    uri = f"{shared_folder(spark).rstrip('/')}/{home.name}-{uuid.uuid4().hex}.zip"
    store, place = fs.FileSystem.from_uri(uri)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(data.getvalue())
    context.addPyFile(uri)
    _shipped.add(context.applicationId)
