"""Files of a folder that driver and executors share, by the paths Spark gives."""

from __future__ import annotations

import re
import sys

from pyarrow import fs
from pyspark import cloudpickle

# Executors need not have this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (``file:/x``, ``/x``, ``hdfs://host/x``, ...) and the path in it."""
    m = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)", path, re.S)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), m[3] if m else path
    system, base = fs.FileSystem.from_uri(f"{m[1]}:{m[2] or '//'}/")
    return system, base.rstrip("/") + m[3]
