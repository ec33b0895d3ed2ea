"""Sizes of texts in tokens of a public tokenizer (a rank file of byte pair merges), counted over whole texts.

Null text has a null size, empty text 0 tokens. The vocabulary's path is a parameter; it is read once by
each Python worker and never copied.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Where the vocabulary lies on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, keep: list[str], text_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens BIGINT``; the text itself isn't carried on."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType())])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            n = [None if (t := x.as_py()) is None else len(encode(t)) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(arrow.field(i).type) for i in range(len(keep))), pa.array(n, pa.int64())], schema=arrow)

    return df.select(*keep, text_column).mapInArrow(count, schema)
