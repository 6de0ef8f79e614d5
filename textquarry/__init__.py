"""Retrieval, ranking and log analytics on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Makes the package importable on Python workers: sends it along, once for each application, where their path doesn't have it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    beside = context.master.startswith("local[") and os.path.abspath(os.getcwd()) == root
    if root in paths or beside or "site-packages" in root or context.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(), "textquarry.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
