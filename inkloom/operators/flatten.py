"""Nested records to related flat tables, by Arrow list offsets and parent indices.

``flatten`` turns a table with arrays of objects (of arrays of objects ...) into one
flat table a level. It never looks at single rows: for every list column Arrow's
``list_parent_indices`` says which parent a child has, ``list_flatten`` gives the
children, and one ``take`` of the parents' keys by those indices carries the keys
down. A child's position comes from its index less its parent's first one.

Odd input: null or empty arrays give no children; null elements give a row with
null fields; null keys stay null; an empty table gives empty tables; columns that
are neither key nor part of the path are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def field(column: pa.Array, name: str) -> pa.Array:
    """A field of a struct array, null where the struct is."""
    return pc.struct_field(column, name)


def children(keys: dict[str, pa.Array], lists: pa.Array, position: str) -> tuple[dict[str, pa.Array], pa.Array]:
    """One level down: the keys of every child, with its place in its parent as ``position``, and the children."""
    parent = pc.list_parent_indices(lists)
    p = parent.to_numpy(zero_copy_only=False)
    first = np.searchsorted(p, p, side="left") if len(p) else p
    return {**{k: v.take(parent) for k, v in keys.items()}, position: pa.array(np.arange(len(p)) - first, pa.int32())}, pc.list_flatten(lists)


def flatten(df: DataFrame, keys: list[str], path: list[tuple[str, str]], fields: dict[str, str]) -> DataFrame:
    """The rows of the last level of ``path``, with the keys and the positions of all levels above.

    ``path``: (name of the list in its parent, name for the position in it), from
    the top-level column down. ``fields``: name in the result to name in the element;
    the name ``"."`` is the element itself.
    """
    kinds = {k: df.schema[k].dataType for k in keys}
    at: T.DataType = T.StructType([df.schema[path[0][0]]])
    for name, _ in path:
        at = at[name].dataType.elementType
    schema = T.StructType([*(T.StructField(k, v) for k, v in kinds.items()), *(T.StructField(n, T.IntegerType()) for _, n in path), *(T.StructField(n, at if f == "." else at[f].dataType) for n, f in fields.items())])
    arrow = to_arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = {x: b.column(x) for x in keys}
            col = b.column(path[0][0])
            for i, (name, position) in enumerate(path):
                k, col = children(k, field(col, name) if i else col, position)
            out = {**k, **{n: col if f == "." else field(col, f) for n, f in fields.items()}}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.select(*keys, path[0][0]).mapInArrow(go, schema)


