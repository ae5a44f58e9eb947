"""Running a function of the rows of many meshes at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_batch(run: Callable[..., pd.DataFrame | None], schema: str, *tables: DataFrame) -> DataFrame:
    """``run`` on many meshes at a time, with a pair for each of the tables: the rows, those of a mesh together, and where each mesh's rows begin, with the end of the last.

    The meshes are those of any of the tables, in one order for all. A mesh is packed into one
    row, so that many small ones reach Python together: a group or cogroup of its own costs a mesh
    some milliseconds.
    """
    columns = [[c for c in t.columns if c != "mesh_id"] for t in tables]
    packed = [t.groupBy("mesh_id").agg(F.collect_list(F.struct(*c)).alias(f"t{i}")) for i, (t, c) in enumerate(zip(tables, columns, strict=True))]
    rows = reduce(lambda x, y: x.join(y.hint("merge"), "mesh_id", "full"), packed)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def unpack(batch: pa.RecordBatch, i: int, own: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
        lists = batch.column(f"t{i}")
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = dict(zip(own, lists.flatten().flatten(), strict=True))
        ids = np.repeat(batch.column("mesh_id").to_numpy(zero_copy_only=False), size)
        return pd.DataFrame({"mesh_id": ids, **{c: v.to_pandas() for c, v in parts.items()}}), np.r_[0, np.cumsum(size)]

    def batches(found):
        for batch in found:
            if not batch.num_rows:
                continue
            whole = run(*(unpack(batch, i, own) for i, own in enumerate(columns)))
            if whole is not None and len(whole):
                yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(whole[f.name], type=f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(batches, schema)
