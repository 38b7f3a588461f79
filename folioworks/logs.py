"""The package's logger: its level from the environment, Spark's chatter kept down."""

from __future__ import annotations

import logging
import os

from pyspark.sql import SparkSession


def logger(name: str = "folioworks", variable: str = "FOLIOWORKS_LOG_LEVEL") -> logging.Logger:
    log = logging.getLogger(name)
    level = os.environ.get(variable, "WARNING").upper()
    log.setLevel(level if level in logging.getLevelNamesMapping() else "WARNING")
    return log


def quiet(spark: SparkSession, level: str = "ERROR") -> None:
    """Spark's and its readers' warnings of broken files are in the results' error columns already."""
    spark.sparkContext.setLogLevel(level)
    logging.getLogger("py4j").setLevel(logging.ERROR)
