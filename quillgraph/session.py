"""Session construction, object-store settings and the shared work folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

WORK_DIR_CONF = "spark.checkpoint.dir"

# Settings that do not depend on the size of the cluster. Shuffle partitions
# start high and are coalesced by AQE from measured sizes.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app_name: str = "quillgraph", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or get) a session with the library defaults; ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def object_store_conf(endpoint: str, *, path_style: bool = True, ssl: bool = True,
                      max_connections: int = 50, magic_committer: bool = True,
                      access_key_env: str = "ACCESS_KEY",
                      secret_key_env: str = "SECRET_KEY") -> dict[str, str]:
    """``spark.hadoop.fs.s3a.*`` settings; secrets come from the environment only."""
    prefix = "spark.hadoop.fs.s3a."
    conf = {
        prefix + "impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        prefix + "endpoint": endpoint,
        prefix + "path.style.access": str(path_style).lower(),
        prefix + "connection.ssl.enabled": str(ssl).lower(),
        prefix + "connection.maximum": str(max_connections),
        prefix + "committer.magic.enabled": str(magic_committer).lower(),
    }
    access, secret = os.environ.get(access_key_env), os.environ.get(secret_key_env)
    if access and secret:
        conf[prefix + "aws.credentials.provider"] = (
            "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider")
        conf[prefix + "access.key"] = access
        conf[prefix + "secret.key"] = secret
    return conf


# Temporary folder of each local application that has no folder configured.
_LOCAL_FOLDERS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, where driver and tasks share one disk, may fall back
    to a temporary folder of its own.
    """
    configured = spark.conf.get(WORK_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {WORK_DIR_CONF} to a folder all executors can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="quillgraph-")
    return _LOCAL_FOLDERS[context.applicationId]


# Paths handed out in this process, so that they can be given back.
_PATHS: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared work folder."""
    _PATHS.append(f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    deleted = 0
    for path in paths:
        location = jvm.org.apache.hadoop.fs.Path(path)
        deleted += bool(location.getFileSystem(conf).delete(location, True))
    return deleted


def drop_work(spark: SparkSession) -> int:
    """Delete what this process wrote below the work folder; DataFrames that
    read it must not be used any more. Returns the number of paths deleted."""
    paths, _PATHS[:] = list(_PATHS), []
    return _delete(spark, paths)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written below the work folder inside the block is deleted at its end, also
    after a failure. Write results to a path taken before it."""
    before = len(_PATHS)
    try:
        yield
    finally:
        paths, _PATHS[before:] = _PATHS[before:], []
        _delete(spark, paths)


# Shuffle files of a query go when it ends, not when the driver collects its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` below the work folder and read it back; ``options`` are the writer's.

    Cuts the lineage, survives the loss of executors, fixes values that depend
    on partitioning, and gives the planner real sizes. What was shuffled for it is
    given back.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)
