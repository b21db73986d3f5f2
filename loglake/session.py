"""Session settings that the jobs rely on, and the package for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # as a Python dict: the last key stays
    "spark.sql.variant.allowDuplicateKeys": "true",
    # the JVM never compiles a method of over 8000 bytes; a stage that has one is cut into smaller ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime settings, and ship the package once to this application's workers."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="loglake-"), "loglake.zip")
        with zipfile.ZipFile(path, "w") as z:
            for top, _, names in os.walk(here):
                for n in names:
                    if n.endswith((".py", ".yaml", ".json")):
                        z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), os.path.dirname(here)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
