"""Result tables, history, metadata and models on storage."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightops.operators.features import HISTORY_KEYS
from flightops.schema import FEATURES
from flightops.session import filesystem


def write_results(frames: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Each named table into its own folder, as Parquet or CSV with header."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(f"{path}/{name}")
        else:
            writer.format(fmt).save(f"{path}/{name}")


def write_history(stats: dict[str, DataFrame], path: str) -> None:
    write_results(stats, f"{path}/history")


def read_history(spark: SparkSession, path: str, names=tuple(HISTORY_KEYS)) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/history/{n}") for n in names}


def write_metadata(df: DataFrame, path: str) -> None:
    """The one-row run record as JSON."""
    df.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_importance(df: DataFrame, path: str) -> None:
    """Feature importance (one row per feature) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/feature_importance")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


# -- versioned sets -------------------------------------------------------------

_MANIFEST = "name string, format string, schema string, rows long, checksum string"


class BrokenSet(ValueError):
    """A set that is not whole: a member is missing, or is not the one that was published."""


def _checksum(df: DataFrame) -> tuple[int, str]:
    """Number of rows and sum of their 64-bit hashes, which depend on no order."""
    hashes = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    found = df.agg(F.count(F.lit(1)).alias("rows"),
                   F.sum(hashes.cast("decimal(20,0)")).cast("string").alias("checksum")).first()
    return found["rows"], found["checksum"] or "0"


def _read_member(spark: SparkSession, path: str, fmt: str, schema: str | None) -> DataFrame:
    if fmt == "model":  # the trees; the other stages hold parameters only
        return spark.read.parquet(f"{path}/stages/*/data")
    reader = spark.read.schema(T.StructType.fromJson(json.loads(schema)))
    return reader.option("header", True).format(fmt).load(path)


def write_set(
    tables: dict[str, DataFrame], path: str, formats: dict[str, str] | None = None,
    model: PipelineModel | None = None,
) -> str:
    """Write tables, and a model, that belong together as a new version; returns its folder.

    ``formats`` names members that are not Parquet (csv, json). The manifest, one row per member
    with schema, rows and checksum of what is on storage, is written last: a version without it
    is not published. Older versions stay as they are.
    """
    spark = next(iter(tables.values())).sparkSession
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    version = f"{path}/version-{stamp}-{uuid.uuid4().hex[:8]}"
    formats, members = formats or {}, []
    for name, df in tables.items():
        fmt, target = formats.get(name, "parquet"), f"{version}/{name}"
        writer = df.coalesce(1) if fmt != "parquet" else df  # small files for people to read
        writer.write.option("header", True).format(fmt).save(target)
        schema = df.schema.json()
        members.append((name, fmt, schema, *_checksum(_read_member(spark, target, fmt, schema))))
    if model is not None:
        model.write().save(f"{version}/model")
        members.append(("model", "model", None, *_checksum(
            _read_member(spark, f"{version}/model", "model", None))))
    spark.createDataFrame(members, _MANIFEST).coalesce(1).write.json(f"{version}/manifest")
    return version


def published(spark: SparkSession, path: str) -> list[str]:
    """Folders of the published versions, oldest first."""
    fs, _ = filesystem(spark, path)
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/manifest/_SUCCESS")
    found = fs.globStatus(pattern) or []
    return sorted(str(status.getPath().getParent().getParent()) for status in found)


def read_set(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version (the last one published), by name.

    Every member is compared with the manifest first. A version that was never published, or
    whose members were changed, taken from another one or lost, raises ``BrokenSet``.
    """
    versions = published(spark, path)
    wanted = version or (versions[-1] if versions else f"{path}/version-*")
    if not any(v.endswith(wanted.rpartition("/")[2]) for v in versions):
        raise BrokenSet(f"{wanted} is not published")
    tables = {}
    for m in spark.read.schema(_MANIFEST).json(f"{wanted}/manifest").collect():
        target = f"{wanted}/{m['name']}"
        try:
            table = _read_member(spark, target, m["format"], m["schema"])
            same = _checksum(table) == (m["rows"], m["checksum"])
        except (AnalysisException, Py4JJavaError) as error:
            raise BrokenSet(f"{target} cannot be read") from error
        if not same:
            raise BrokenSet(f"{target} is not what was published")
        if m["format"] != "model":
            tables[m["name"]] = table
    return tables


def read_set_model(spark: SparkSession, path: str, version: str | None = None) -> PipelineModel:
    """The model of a version whose members are all as they were published."""
    read_set(spark, path, version)
    return PipelineModel.load(f"{version or published(spark, path)[-1]}/model")


def feature_list(spark: SparkSession, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The model inputs in their order, as a table of their own."""
    return spark.createDataFrame(list(enumerate(features)), "position int, feature string")
