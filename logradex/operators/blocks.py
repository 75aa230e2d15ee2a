"""Work in blocks of about equal size."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(df: DataFrame, n: int, keys: tuple[str, ...] = ("estado", "municipio"), name: str = "bloco") -> DataFrame:
    """Each row with one of the blocks 1 to n, rows of one place together: places, the largest first, go
    to the block that has fewest rows (of several, the first).

    Rows are counted by place in Spark; the driver sees one row for each place, of which there are thousands.  A
    place of nulls is a place like others.
    """
    if n < 1:
        raise ValueError("there must be a block at least")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).collect()
    sizes.sort(key=lambda r: (-r.n, *[(r[k] is not None, r[k]) for k in keys]))
    loads = [(0, block) for block in range(1, n + 1)]
    chosen = []
    for row in sizes:
        load, block = loads[0]
        heapq.heapreplace(loads, (load + row.n, block))
        chosen.append((*[row[k] for k in keys], block))
    kinds = ", ".join(f"_{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    table = df.sparkSession.createDataFrame(chosen, f"{kinds}, {name} int")
    on = [df[k].eqNullSafe(table[f"_{i}"]) for i, k in enumerate(keys)]
    return df.join(table, on).select(*[df[c] for c in df.columns], name)
