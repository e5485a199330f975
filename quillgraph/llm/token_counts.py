"""Token counts of whole texts by a compiled finite-state tokenizer.

``transducer`` has the machines; here they run in the tasks of a scan, without
a shuffle.  A worker process compiles the tokenizer file once.  Its memory is
the transition table, one window of text and one Arrow batch, whatever the
length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import transducer
from quillgraph.llm.common import text_of
from quillgraph.llm.packing import default_tokenizer

LIMIT = 512


def count_tokens(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``n_tokens`` is the length of what the ``tokenizers`` library gives for the
    whole text without added special tokens; a special token's string inside a
    text counts as that token, as is the library's default.  ``n_bytes`` are
    UTF-8 bytes.  Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows
    and null ids are counted row by row; no rows give no rows; other columns,
    whatever their names, are not read.  ``tokenizer`` is a byte-level BPE file
    (``.json``); any other kind raises ``ValueError``.
    """
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = transducer.compiled(path).counts
        for batch in batches:
            n_tokens = pa.array(counts(text.as_py() for text in batch.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_tokens], schema=schema)

    text = text_of()
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = told.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
