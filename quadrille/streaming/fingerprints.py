"""Dedup of arriving fingerprints with the sizes seen so far as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quadrille.operators.dedup import KEY, Sizes

STATE = "ids array<long>, sizes array<double>"


def _arrive(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ids, flat = (list(x) for x in state.get) if state.exists else ([], [])
    kept, out = Sizes(), []
    for n, i in enumerate(ids):
        kept.keep(int(i), tuple(flat[3 * n : 3 * n + 3]))
    rows = pd.concat(list(batches)).sort_values("mesh_id")
    for r in rows.itertuples(index=False):
        size = (r.sx, r.sy, r.sz)
        twin = kept.first_close(size)
        if twin is None:
            kept.keep(int(r.mesh_id), size)
            ids.append(int(r.mesh_id))
            flat += size
        out.append((r.mesh_id, r.mesh_id if twin is None else twin))
    state.update((ids, flat))
    yield pd.DataFrame(out, columns=["mesh_id", "keep_id"])


def dedup_stream(prints: DataFrame) -> DataFrame:
    """(mesh_id, keep_id) of a stream of fingerprints, batch by batch and within a batch by mesh id.

    The state of a key are the sizes it has kept; they are the result's own first rows, so it
    grows only with meshes that differ.
    """
    return prints.groupBy(*KEY).applyInPandasWithState(_arrive, "mesh_id long, keep_id long", STATE, "append", GroupStateTimeout.NoTimeout)
