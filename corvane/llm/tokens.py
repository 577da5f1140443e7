"""Token counts of texts under a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.spread import spread

#: Folder and file of the vocabulary; both may be given by the caller.
TOKENIZERS, VOCABULARY = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"

#: Fixed value: how byte-level BPE splits text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoder(path: str):
    """The encoder of a rank file, built once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corvane", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(table: DataFrame, *, key: str, text: str, keep: tuple[str, ...] = (), path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(``key``, *``keep``, ``tokens``): tokens of the whole text; a null text has 0. No shuffle.

    The rank file is sent to the executors, which need no copy of their own.
    """
    table.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            n = np.fromiter((len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], [*b.schema.names[:-1], "tokens"])

    source = spread(table, key).select(key, *keep, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{kept}, tokens bigint")
