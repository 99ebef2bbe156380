"""Token counts of whole texts by compiled transducers (see bpe_transducer).

Defined cases: null or empty texts count 0; texts of any length are read whole, in pieces cut where a pre-token
starts whatever stands around; repeated rows are counted each; special strings inside a text count as the
library's default has it; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_arrow, only


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", limit: int = 1024, most_states: int = 150_000) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of docs(key, text)."""
    from .bpe_transducer import encoder

    d = only(docs, key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter(encoder(path, most_states).each_count([t or "" for t in b.column(2).to_pylist()]), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=[key, "n_bytes", "n_tokens"])

    d = d.select(key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = T.StructType([d.schema[key], T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])
    return map_arrow(d, run, out).withColumn("over_limit", F.col("n_tokens") > limit)
