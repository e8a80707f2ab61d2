"""Byte-pair encoding and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from scoreline.llm.bpe_merge import Remembered, merge_symbols
from scoreline.llm.common import column, id_text, portions
from scoreline.llm.pretokens import chunks, pretokens, segments, vocabulary


class Codec:
    """Encodes by a priority queue of merge ranks over a linked symbol list; decodes by
    concatenating the vocabulary's strings."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.pretoken = Remembered(self._pretoken)
        #: part of a text -> (its tokens, their ids joined by commas, their strings joined); a
        #: pretoken is a part of its own, so what digests() remembers is here alone
        self.part = Remembered(self._part)

    def _pretoken(self, pretoken: str) -> tuple[int, ...]:
        symbols = [self.vocab.byte_id[b] for b in pretoken.encode("utf-8", "surrogatepass")]
        merge_symbols(symbols, self.vocab.ranks, self.vocab.merged)
        return tuple([s for s in symbols if s >= 0])

    def _part(self, part: str) -> tuple[int, bytes, bytes]:
        found = pretokens(part)
        if found == [part]:
            ids = self._pretoken(part)
            return len(ids), b",".join([b"%d" % i for i in ids]), self._strings(ids)
        counts, numbers, strings = zip(*map(self.part.__getitem__, found))
        return sum(counts), b",".join(numbers), b"".join(strings)

    def _strings(self, ids: list[int]) -> bytes:
        return b"".join([self.vocab.text[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece, added in segments(text, self.vocab):
            if added:
                ids.append(self.vocab.added[piece])
            else:
                for parts in chunks(piece):
                    ids += [i for part in parts for p in pretokens(part) for i in self.pretoken[p]]
        return ids

    def decode(self, ids: list[int]) -> str:
        return self._strings(ids).decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and the SHA-256 of the ids and of the decoded text."""
        n, ids, decoded, comma = 0, hashlib.sha256(), hashlib.sha256(), b""
        for piece, added in segments(text, self.vocab):
            if added:
                i = self.vocab.added[piece]
                coded = [(1, b"%d" % i, self.vocab.text[i])]
            for parts in [[piece]] if added else chunks(piece):
                rows = coded if added else list(map(self.part.__getitem__, parts))
                if rows:
                    counts, numbers, strings = zip(*rows)
                    n += sum(counts)
                    ids.update(comma + b",".join(numbers))
                    # pieces end between characters, so each decodes by itself
                    decoded.update(b"".join(strings).decode("utf-8", "replace").encode())
                    comma = b","
        return n, ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (an array) of every row; null and empty texts give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary_path)
        for batch in batches:
            texts = column(batch, "text")
            for i in range(0, len(texts), 256):
                ids = pa.array([codec.encode(t) for t in texts[i : i + 256]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), ids], ["doc_id", "ids"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text; a null array decodes to the empty text, broken UTF-8 to U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary_path)
        for batch in batches:
            texts = pa.array([codec.decode(ids or []) for ids in column(batch, "ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded and decoded in one pass,
    slice by slice, so that no token list of a whole long text is held.

    Null and empty texts have 0 tokens and the digests of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary_path)
        for batch in portions(batches):
            n, ids, decoded = [], [], []
            for text in column(batch, "text"):
                a, b, c = codec.digests(text)
                n.append(a)
                ids.append(b)
                decoded.append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
