"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ensure_importable(spark: SparkSession) -> None:
    """Python workers must find this package: ship it with the session unless their path already has it."""
    here = str(ROOT)
    if here in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.realpath(os.getcwd()) == os.path.realpath(here):
        return
    sc = spark.sparkContext
    if getattr(sc, "_frameloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="frameloom-")
    sc.addPyFile(shutil.make_archive(f"{folder}/frameloom", "zip", here, "frameloom"))
    sc._frameloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; a local session may do without the setting."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="frameloom-shared-")
        sc.setCheckpointDir(root)
    return f"{root}/frameloom-{uuid.uuid4().hex}"


def local_session(cores: str = "*", **conf) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("frameloom")
    base = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k: str(v) for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
