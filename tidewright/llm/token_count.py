"""Token counts in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import tokens
from tidewright.llm.common import id_and_bytes, sliced


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs.

    Texts go to the library's batch encoder, a few MB at a time; long ones are cut at boundaries
    that no token spans, so their parts may lie in several batches and no batch is larger than
    others. With a byte-level tokenizer all texts are cut into short pieces, and the encoder gets
    each distinct piece of a batch once (``tokens.Counts``). Where the tokenizer's settings prove
    no boundary safe, texts stay whole. Null text:
    empty, 0 tokens. Null and repeated ids, and repeated rows: every row is counted by itself.
    Empty table: empty result. Other columns of docs are left out, so names can't clash. path: a
    tokenizer file that every executor has.
    """

    def run(batches):
        for b in sliced(batches):
            raw = b.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array([len(d or b"") for d in raw], pa.int64()), "n_tokens": pa.array(tokens.lengths(path, raw), pa.int64())})

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
