"""Statistics of a whole text that judge its quality."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scoreline.llm.common import column, id_text, portions

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 3
#: The counts of the query, then what the models read besides.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "symbol_share", "symbol_words", "repeat_share", "dup_line_share", "upper_share", "digit_share",
    "mark_share", "bar_share", "stop_share", "distinct_share", "mean_word", "line_words",
)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of WINDOW words that occur twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = end = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def statistics_of(text: str) -> tuple[list[int], list[float]]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    one = max(1, n)
    letters = max(1, chars)
    shares = [
        symbols / letters,
        sum(w[-1] in b"#*$%&|<>" for w in words) / one,
        repeats / one,
        dup_lines / max(1, len(lines)),
        len(_UPPER.findall(text)) / letters,
        len(_DIGIT.findall(text)) / letters,
        text.count("!") / one,
        words.count(b"|") / one,
        (text.count(".") + text.count(",")) / one,
        len(set(words)) / one,
        chars / one,
        n / max(1, len(lines)),
    ]
    return [n, chars, symbols, dup_lines, repeats], shares


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the COUNTS (long) and the SHARES (double) of every row. A null or empty text, or one
    of white space alone, has all counts 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [statistics_of(t) for t in column(batch, "text")]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(COUNTS))
            shares = np.array([f[1] for f in found], np.float64).reshape(-1, len(SHARES))
            arrays = [pa.array(m[:, k]) for m in (counts, shares) for k in range(m.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *COUNTS, *SHARES])

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = [f"doc_id {kind}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHARES)]
    return rows.mapInArrow(run, ", ".join(schema))
