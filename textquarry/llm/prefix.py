"""Running sums over one global order, without putting all rows in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions


def running_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with, for each name: column of `sums`, the sum of that long column over all rows up to and with this one.

    order: sort expressions; rows that they don't tell apart come in any order. The rows are range-partitioned and
    sorted, summed within each partition, and written; then each partition adds the totals of those before it (one
    row for each partition: that is all that is broadcast). Null counts as 0.
    """
    spark = df.sparkSession
    schema = df.schema
    names = list(sums)

    def local(batches):
        part = TaskContext.get().partitionId()
        base = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            columns = [batch.column(n) for n in schema.names]
            for i, n in enumerate(names):
                up = base[i] + np.cumsum(batch.column(sums[n]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                if len(up):
                    base[i] = up[-1]
                columns.append(pa.array(up))
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, *names, "_part"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), *(f"`{n}` long" for n in names), "_part int"])
    sorted_rows = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    summed = saved(sorted_rows.mapInArrow(local, kinds))
    totals = summed.groupBy("_part").agg(*[F.max(n).alias(n) for n in names]).collect()  # a row for each partition
    before, base = [], dict.fromkeys(names, 0)
    for row in sorted(totals, key=lambda r: r["_part"]):
        before.append((row["_part"], *(base[n] for n in names)))
        base = {n: base[n] + row[n] for n in names}
    offsets = spark.createDataFrame(before, "_part int" + "".join(f", `_before_{n}` long" for n in names))
    return summed.join(F.broadcast(offsets), "_part").select(*[F.col(f"`{c}`") for c in schema.names], *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names])
