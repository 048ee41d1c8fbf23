"""Arrow batches of a sorted partition, cut at the borders of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def complete_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal ``key``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(b.schema.get_field_index(key)))
        if held and np.asarray(held[-1].column(held[-1].schema.get_field_index(key)))[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)
