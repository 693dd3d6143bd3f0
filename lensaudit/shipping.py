"""The package's code on executors that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends the package to the executors once a context, unless their Python path or working directory has it as in local runs."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    known = [os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if str(root) in known or os.path.exists(os.path.join(os.getcwd(), "lensaudit", "__init__.py")) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="lensaudit-code-"), "lensaudit.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "lensaudit").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(path)
