"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # history and carrier tables are read from files, so their size is known
    # when the join is planned; above this size they are shuffled instead
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # percentiles by route keep one small map per group; with thousands of groups the
    # default of 128 would fall back to sorting all rows of a task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "flightops", master: str | None = None, **conf) -> SparkSession:
    """Session with the package defaults; ``conf`` keys use ``__`` for ``.``.

    ``spark.sql.shuffle.partitions`` is left to the cluster; ``size_shuffles`` raises it
    for large inputs and AQE merges small partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a session that runs in one process (``local`` or ``local[n]``) may do without: it
    gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="flightops-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_STAGED: dict[tuple, tuple[DataFrame, DataFrame]] = {}
_RECENT: dict[tuple, tuple[DataFrame, DataFrame]] = {}  # the same, last used at the end
_FOLDERS: set[str] = set()

# rows that a sort holds against compressed columns: a leg takes about 250 bytes, its line 12 to 18
_EXPANSION = 16
_PARTITION_BYTES = 128 << 20


def session_folder(spark: SparkSession) -> str:
    """Where this session keeps its staged tables; it goes when the application ends."""
    path = f"{shared_folder(spark)}/flightops/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        fs, target = filesystem(spark, path)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _FOLDERS.add(path)
    return path


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables this session staged; frames read from them become unusable."""
    fs, folder = filesystem(spark, session_folder(spark))
    fs.delete(folder, True)
    _FOLDERS.discard(session_folder(spark))
    app = spark.sparkContext.applicationId
    for kept in (_STAGED, _RECENT, _REMEMBERED):
        for key in [k for k in kept if k[0] == app]:
            del kept[key]


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop API, which serves every storage Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, target = filesystem(spark, path)
    fs.delete(target, True)


def _source_state(spark: SparkSession, paths: tuple[str, ...]) -> tuple:
    """Length and last change of each file or folder: one call per path, no listing.

    Writers replace, add and remove files, which changes the time of their folder.
    """
    states = []
    for path in paths:
        fs, target = filesystem(spark, path)
        status = fs.getFileStatus(target)
        states.append((path, status.getLen(), status.getModificationTime()))
    return tuple(states)


def stored_bytes(spark: SparkSession, paths: tuple[str, ...]) -> int:
    """Bytes of all files under the paths, which are listed for it."""
    found = 0
    for path in paths:
        fs, target = filesystem(spark, path)
        found += fs.getContentSummary(target).getLength()
    return found


def size_shuffles(spark: SparkSession, sources: tuple[str, ...]) -> None:
    """Raise ``spark.sql.shuffle.partitions`` so that a full shuffle of these files has
    partitions of about 128 MB; it is never lowered."""
    wanted = stored_bytes(spark, sources) * _EXPANSION // _PARTITION_BYTES
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


def source_key(spark: SparkSession, name: str, sources: tuple[str, ...]) -> tuple:
    """Names a result of these files in their present state, in this session."""
    return (spark.sparkContext.applicationId, name, sources, _source_state(spark, sources))


_REMEMBERED: dict[tuple, object] = {}


def remembered(spark: SparkSession, name: str, sources: tuple[str, ...], build: Callable):
    """What ``build`` returned for these sources in their present state, in this session.

    ``name`` must say all that the result depends on besides the sources. A hit plans and lists
    nothing.
    """
    key = source_key(spark, name, sources)
    if key not in _REMEMBERED:
        _REMEMBERED[key] = build()
    return _REMEMBERED[key]


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside drop their shuffle files when they end.

    Nothing reads them after the table is stored; else they stay beside it until the driver
    happens to collect its garbage.
    """
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP)
        else:
            spark.conf.set(_DROP, before)


def staged(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], sources: tuple[str, ...] = (),
    recent: int | None = None,
) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where a frame feeds several jobs: its work runs once, later reads prune
    columns and push filters, the planner knows the size, and a lost executor
    costs a re-read instead of the whole lineage. A frame with the same plan over
    the same state of ``sources`` and of the folders it reads is read from the table
    that the session has; any other frame is written anew.

    Frames are told apart by their plans, which the driver holds as long as the session.
    With ``recent`` it holds those of that many frames only, the last used of such calls.
    """
    kept = _STAGED if recent is None else _RECENT
    df = build()
    key = (spark.sparkContext.applicationId, name, df.semanticHash(),
           _source_state(spark, tuple(sorted({*sources, *_input_folders(spark, df)}))))
    if key in kept and df.sameSemantics(kept[key][0]):
        if recent is not None:
            kept[key] = kept.pop(key)
        return kept[key][1]
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.parquet(path)
    kept[key] = df, table
    while recent is not None and len(kept) > recent:
        del kept[next(iter(kept))]
    return table


def _input_folders(spark: SparkSession, df: DataFrame) -> set[str]:
    """Paths that the plan reads, as they were given; staged tables do not change."""
    own = session_folder(spark).removeprefix("file://")
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            continue
        relation = leaf.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            paths = relation.location().rootPaths()
            found |= {paths.apply(n).toString() for n in range(paths.size())}
    return {path for path in found if own not in path}
