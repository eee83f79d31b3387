"""Token counts (operator 2): rank-synchronous array merging.

Batched pre-tokens are held as ragged numpy arrays; each round applies every sequence's lowest-rank pair at once and
the surviving symbols are counted. No shuffle: each task counts the texts that it reads, in blocks of bounded bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe, rows

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def text_bytes(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch as one byte array, and their offsets in it."""
    col = rows.utf8_column(batch, text)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def count_tokens(df: DataFrame, path: str | None = None, limit: int = LIMIT, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row for each row of df.

    Null and empty texts have 0 bytes and 0 tokens. Null keys, repeated rows and ties each keep their row. Other
    columns of df, whatever their names, are not carried. An empty table gives an empty result.
    """
    path = path or bpe.vocabulary_path(VOCABULARY)
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(key, text)

    def run(batches):
        coder = bpe.encoder(path)
        for batch in rows.slices(batches, text):
            data, offsets = text_bytes(batch, text)
            _, counts = coder.encode(data, offsets, ids=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.arrow_map(narrow, run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(rows.documents(spark, sf_dir))
