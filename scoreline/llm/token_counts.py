"""Token counts of whole texts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.bpe_merge import Remembered, merge_symbols
from scoreline.llm.common import column, id_text, portions
from scoreline.llm.pretokens import chunks, pretokens, segments, vocabulary


class Counter:
    """Tokens of a text: initial symbols minus merges; no identifiers are made."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.part = Remembered(self._part)

    def _pretoken(self, pretoken: str) -> int:
        symbols = [self.vocab.byte_id[b] for b in pretoken.encode("utf-8", "surrogatepass")]
        return len(symbols) - merge_symbols(symbols, self.vocab.ranks, self.vocab.merged)

    def _part(self, part: str) -> int:
        found = pretokens(part)
        if found == [part]:
            return self._pretoken(part)
        return sum(map(self.part.__getitem__, found))

    def count(self, text: str) -> int:
        total = 0
        for piece, added in segments(text, self.vocab):
            if added:
                total += 1
            else:
                for parts in chunks(piece):
                    total += sum(map(self.part.__getitem__, parts))
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, one narrow stage.

    Null and empty texts have 0 bytes and 0 tokens. Rows with a null or repeated id keep a row each.
    A very long text is split where a pretoken must start and counted slice by slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path)
        for batch in portions(batches):
            n = pa.array([counter.count(t) for t in column(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = id_text(docs, id_col, text_col)
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
