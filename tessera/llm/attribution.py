"""Token counts of sections by offsets.

A document is encoded once, as a whole, and its tokens' byte lengths give their places. The sections of a text tile it
(the lines of a text, or fields that are joined with a mark between them). An interval join of tokens and sections, one
sorted search in the arrays of a text, finds the sections that a token touches; a token that crosses a boundary is
allocated by an explicit rule:

- "start": to the section with its first byte;
- "largest": to the one with most of its bytes, the first of equals;
- "share": to all, by their shares of its bytes.

The counts of a document's sections sum to its tokens whatever the rule. Offsets in the result count code points.

A null or empty text has one empty section without tokens. Repeated rows give repeated results. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, slices, table, text_only
from .tokens import byte_lengths, default_vocabulary, encode

RULES = ("start", "largest", "share")


def lines(raw: np.ndarray) -> np.ndarray:
    """Where the sections of a text begin, and its end: a line has its line feed."""
    begins = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], begins[begins < len(raw)], [len(raw)]])


def allocate(lengths: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many touch it and another one. lengths: of the tokens in bytes; edges: of the sections."""
    n = len(edges) - 1
    end = np.cumsum(lengths)
    begin = end - lengths
    first = np.clip(np.searchsorted(edges, begin, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(edges, end, "left") - 1, 0, n - 1)
    counts = np.bincount(first, minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for t in np.flatnonzero(last > first):
        over = np.arange(first[t], last[t] + 1)
        share = np.minimum(edges[over + 1], end[t]) - np.maximum(edges[over], begin[t])
        crossing[over[share > 0]] += 1
        if rule != "start":
            counts[first[t]] -= 1
            counts[over] += share / lengths[t] if rule == "share" else np.arange(len(over)) == share.argmax()
    return counts, crossing


def count_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "start", sections=lines) -> DataFrame:
    """doc_id, section (from 0), start, end, n_tokens, n_crossing of every section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    arrow(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = byte_lengths(vocabulary)
        for batch in slices(batches):
            doc, section, start, end, many, crossing = [], [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                edges = sections(raw)
                counts, crossed = allocate(size[encode(vocabulary, text)], edges, rule)
                points = edges if len(text) == len(raw) else np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[edges]
                n = len(counts)
                doc += [d] * n
                section.append(np.arange(n, dtype=np.int32))
                start.append(points[:-1])
                end.append(points[1:])
                many.append(counts)
                crossing.append(crossed)
            columns = [pa.array(doc, pa.int64()), *(pa.array(np.concatenate(x)) for x in (section, start, end, many, crossing))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return text_only(docs).mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")


def count_fields(rows: DataFrame, fields: list[str], doc_id: str, vocabulary: str | None = None, rule: str = "start", mark: str = "\n") -> DataFrame:
    """The same for the columns `fields`, joined with `mark`, which belongs to the field before it; `section` is the field's place in the list. A null field is empty."""
    arrow(rows.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    own = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat_ws(mark, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("text"), F.array(*[F.octet_length(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]).alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, gap = byte_lengths(vocabulary), len(mark.encode())
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for d, text, sizes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "sizes")), strict=True):
                edges = np.cumsum([0, *(s + gap for s in sizes[:-1]), sizes[-1]])
                counts, crossed = allocate(size[encode(vocabulary, text)], edges, rule)
                for column, x in zip(out, ([d] * len(counts), range(len(counts)), counts.tolist(), crossed.tolist()), strict=True):
                    column.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "section", "n_tokens", "n_crossing"])

    return own.mapInArrow(run, "doc_id long, section int, n_tokens double, n_crossing long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
