"""Explainable retrieval, ranking evaluation and training-data operators on PySpark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> str:
    """Sends this package to all executors, which need it wherever rows are worked on in Python; returns the archive's place.

    A cluster on whose machines the package is installed does not need this.
    """
    root = Path(__file__).parent
    place = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(place))
    return str(place)
