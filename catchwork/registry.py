"""The engine's registered queries, their SQL, and shipping of the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .queries import MODULES

_HOME = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless the JVM's own PYTHONPATH already has it."""
    context = spark.sparkContext
    own = context._jvm.System.getenv("PYTHONPATH") or ""
    if str(_HOME.parent) in own.split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    path = Path(tempfile.mkdtemp(prefix="catchwork-ship-")) / "catchwork.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_HOME.rglob("*.py")):
            z.write(f, f.relative_to(_HOME.parent))
    context.addPyFile(str(path))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: served and unserved population by country, with the served index."""
    return queries()["e10_e11_served_index"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, (query, _) in m.query.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.query.items() if sql}
