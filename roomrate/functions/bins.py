"""Right-closed binning.

`Bucketizer` is left-closed (50 -> bin 1); the analysis bins are right-closed
with an open top bin: (0,50] -> 0, (50,100] -> 1, ..., (400, inf) -> 8.
Values <= 0 and NULL fall outside every bin and yield NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomrate import constants as K


def right_closed_bin(x: Column | str, edges=K.PRICE_BIN_EDGES, open_top: bool = True) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    expr = None
    for i in range(1, len(edges)):
        cond = c <= F.lit(edges[i])
        expr = F.when(cond, F.lit(i - 1)) if expr is None else expr.when(cond, F.lit(i - 1))
    if open_top:
        expr = expr.otherwise(F.lit(len(edges) - 1))
    # anything at or below the first edge (and NULL) is outside the bins
    return F.when(c > F.lit(edges[0]), expr).cast("int")
