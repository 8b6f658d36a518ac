"""What iterative operators need: tables that are written out between rounds."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """Write ``rows`` to the checkpoint folder, which all executors share, and go on from there.

    A session on one machine without such a folder (tests) gets a temporary one;
    on a cluster ``spark.checkpoint.dir`` must name it.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="rulemesh-")
        context.setCheckpointDir(folder)
    return rows.checkpoint(eager=True)


def some(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())
