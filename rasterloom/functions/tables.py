"""Region operators as table functions of SQL. They take a table and the partitioning that the operator needs:

    register(spark)
    SELECT * FROM raster_runs(TABLE(pixels) PARTITION BY (image_id, r) ORDER BY (c), 400)
    SELECT * FROM raster_tile_labels(TABLE(runs) PARTITION BY (image_id, strip, block), 4)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from rasterloom.operators.components import joined, touching_pairs

_LONG = T.LongType()
_RUN = T.StructType([T.StructField(c, _LONG) for c in ("image_id", "run_id", "r", "s", "e")])
_LABEL = T.StructType([T.StructField(c, _LONG) for c in ("image_id", "run_id", "blob_id")])


class RunsOfRow:
    """Maximal runs of one row's pixels (image_id, r, c), which come in the order of c; width gives the run_id. Repeated pixels are one.
    Nothing but the open run is held."""

    def __init__(self):
        self.open = None

    def eval(self, row: Row, width: int) -> Iterator[tuple]:
        if self.open and row["c"] <= self.open[2] + 1:
            self.open[2] = row["c"]
            return
        if self.open:
            yield self._run()
        self.open, self.row = [row["image_id"], row["c"], row["c"]], (row["r"], width)

    def _run(self) -> tuple:
        (image, s, e), (r, width) = self.open, self.row
        return image, r * width + s, r, s, e

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self._run()


class LabelsOfTile:
    """Components of one tile's runs (image_id, run_id, r, s, e): the smallest run_id of each. A tile's runs are held together."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.reach = 0

    def eval(self, row: Row, connectivity: int) -> Iterator[tuple]:
        self.rows.append((row["r"], row["s"], row["e"], row["run_id"], row["image_id"]))
        self.reach = int(connectivity == 8)
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        self.rows.sort()
        r, s, e, ids = (np.array([x[k] for x in self.rows], np.int64) for k in range(4))
        least = s.min()
        root = joined(len(r), *touching_pairs(r - r.min(), s - least, e - least, self.reach, int(e.max() - least) + 1))
        for x, label in zip(self.rows, ids[root].tolist()):
            yield x[4], x[3], label


def register(spark: SparkSession) -> None:
    spark.udtf.register("raster_runs", udtf(RunsOfRow, returnType=_RUN))
    spark.udtf.register("raster_tile_labels", udtf(LabelsOfTile, returnType=_LABEL))
