"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "usagelens", cores: str = "*", **conf: object) -> SparkSession:
    """A local session with the settings the library is written for.

    On a cluster the same settings belong into the submit configuration; the
    shuffle-partition count there should be set to the initial upper bound (a few
    per core) because AQE coalesces it per query.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        # no Python stack trace per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediate tables.

    It lies under the shared folder the session names in ``spark.checkpoint.dir``.
    Only a local session without that setting falls back to a temporary folder.
    """
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="usagelens-")
        spark.conf.set(CHECKPOINT_KEY, shared)
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
