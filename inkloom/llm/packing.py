"""Filling containers of fixed capacity: first-fit decreasing with a tournament tree, in randomised groups.

Each group of documents is packed on its own, so groups run in parallel and no task
sees more than a group; only ids and sizes are shuffled, never texts. A group leaves
at most its last container ill filled, which with thousands of documents a group is
well under a thousandth.

Odd input: null text has no size and gets no row; empty text is an item of size 0;
an item over the capacity is cut into full containers and a rest, every other item
stays whole; repeated rows are items of their own; equal sizes are taken in the
order of their ids; an empty table gives no rows; null or non-positive capacities
are left out; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from inkloom.llm.tokens import VOCABULARY, with_tokens

#: Documents in a group, on average.
GROUP = 8192
#: Capacities that one run may have; they are sent to all tasks.
MOST_CAPACITIES = 10_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each size, none over the capacity, given in descending order.

    A complete binary tree holds the free room of every container at its leaves and
    the larger of both children above; the first container with enough room is found
    from the root, going left wherever the left half has room.
    """
    n = len(sizes)
    leaves = 1 << max(1, n - 1).bit_length() if n else 1
    room = [capacity] * (2 * leaves)
    out = np.empty(n, np.int64)
    for k, size in enumerate(sizes.tolist()):
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < size:
                i += 1
        out[k] = i - leaves
        left = room[i] - size
        room[i] = left
        while i > 1:
            if room[i ^ 1] > left:
                left = room[i ^ 1]
            i >>= 1
            if room[i] == left:
                break
            room[i] = left
    return out


def pack(items: DataFrame, capacities: DataFrame, seed: int = 7, group: int = GROUP, counted: DataFrame | None = None) -> DataFrame:
    """``(spec_id, container_id, doc_id, piece_no, start_token, n_tokens)`` for ``items(doc_id, n_tokens)`` and ``capacities(spec_id, capacity)``.

    container_id holds the group in its high and the container in its low 32 bits. Piece
    ``piece_no`` of a document covers its tokens from ``start_token`` on. ``counted``: a table of
    about as many rows that is cheaper to count than ``items``.
    """
    specs = [(r.spec_id, int(r.capacity)) for r in capacities.where("spec_id is not null and capacity > 0").distinct().orderBy("spec_id", "capacity").limit(MOST_CAPACITIES + 1).collect()]
    if len(specs) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    items = items.where("n_tokens is not null")
    groups = max(1, -(-(items if counted is None else counted).count() // group))
    kind, spec_kind = items.schema["doc_id"].dataType.simpleString(), capacities.schema["spec_id"].dataType.simpleString()
    schema = f"spec_id {spec_kind}, container_id bigint, doc_id {kind}, piece_no int, start_token bigint, n_tokens bigint"

    out = to_arrow_schema(_parse_datatype_string(schema))

    def fill(table: pa.Table) -> pa.Table:
        parts, table = [], table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        size, g = table.column("n_tokens").to_numpy(), table.column("g")[0].as_py()
        ids = table.column("doc_id").combine_chunks()
        for spec, capacity in specs:
            full = np.maximum(size - 1, 0) // capacity  # containers that a document fills alone, before its rest
            rest = size - full * capacity
            order = np.lexsort((np.arange(len(size)), -rest))
            bins = np.empty(len(size), np.int64)
            bins[order] = first_fit_decreasing(rest[order], capacity)
            first = int(bins.max(initial=-1)) + 1
            pieces = full + 1
            doc = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            last = piece == full[doc]
            where = np.where(last, bins[doc], 0)
            where[~last] = first + np.arange(int((~last).sum()))
            parts.append(pa.table({"spec_id": pa.array([spec] * len(doc)), "container_id": (np.int64(g) << 32) + where, "doc_id": ids.take(pa.array(doc)), "piece_no": piece.astype(np.int32), "start_token": piece * capacity, "n_tokens": np.where(last, rest[doc], capacity)}))
        return pa.concat_tables([p.cast(out) for p in parts]) if parts else out.empty_table()

    salted = items.select("doc_id", "n_tokens", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "n_tokens"), F.lit(groups)).alias("g"))
    return salted.groupBy("g").applyInArrow(fill, schema)


def pack_documents(documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """The documents' texts in containers of each ``capacity_tokens`` of ``specs``."""
    items = with_tokens(documents, ["doc_id"], "text", vocabulary)
    return pack(items, specs.select("spec_id", F.col("capacity_tokens").alias("capacity")), seed, counted=documents.select("doc_id"))


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, capacity_tokens, n_containers, n_pieces, n_tokens, fill)``: how full the containers of each capacity are."""
    containers = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    total = containers.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return total.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id").select("spec_id", "capacity_tokens", "n_containers", "n_pieces", "n_tokens", "fullest", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))
