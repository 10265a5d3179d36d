"""Session set-up: settings that suit the engine, and shipping of the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()


def settings(lines: list[str], known: dict[str, str] | None = None, override: bool = False) -> dict[str, str]:
    """``KEY=VALUE`` lines over known settings: comments and quotes go, what is known stays unless ``override``."""
    out = dict(known or {})
    for line in lines:
        key, sign, value = line.strip().partition("=")
        key, value = key.removeprefix("export ").strip(), value.strip().strip("'\"")
        if sign and key and not key.startswith("#") and (override or key not in out):
            out[key] = value
    return out


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, where the search path they inherit lacks it."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or any(Path(p).resolve() == root for p in known):
        return spark
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="marlstone-ship-")) / "marlstone.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((root / "marlstone").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    return spark
