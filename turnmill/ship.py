"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

from .batches import bound

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application, through the shared folder that spark.checkpoint.dir names. Its batches get a limit of bytes."""
    bound(spark)
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{sc.applicationId}/turnmill.zip")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(path, True)
        out.write(bytearray(data.getvalue()))
        out.close()
        sc.addPyFile(fs.makeQualified(path).toString())
    else:  # a session without a shared folder, as in tests
        place = tempfile.mkdtemp(prefix="turnmill-")
        atexit.register(shutil.rmtree, place, True)
        with open(os.path.join(place, "turnmill.zip"), "wb") as out:
            out.write(data.getvalue())
        sc.addPyFile(os.path.join(place, "turnmill.zip"))
    _sent.add(sc.applicationId)
