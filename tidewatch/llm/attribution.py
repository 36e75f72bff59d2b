"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, as a whole, because encoding its parts alone would give other tokens at their borders. Every
token has a span of characters, as the tokenizer's offsets give it (a token holding part of a character's bytes spans
that character). Sections are disjoint spans of characters in order. Tokens and sections are joined by interval: each
token is found among the section borders by binary search, for whole documents at once.

A token that crosses a border is allocated by an explicit rule:

``start``   to the section in which it starts
``end``     to the section of its last character
``most``    to the section with most of its characters, the earlier one of equals
``share``   to all sections it touches, by their shares of its characters (counts are then fractions)

Sections of a document: here its lines, each with the line feed that ends it; or given as columns (fields), which are
joined by a separator that belongs to the field before it. A missing or empty text has one empty section without tokens.
Rows are treated one by one, so repeated rows and ids are counted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tokens

RULES = ("start", "end", "most", "share")


def token_spans(ids: np.ndarray, sizes: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of each token of a byte-level encoding of ``raw``. ``sizes`` holds the bytes
    behind each id."""
    ends = np.cumsum(sizes[ids])
    if len(ids) and ends[-1] != len(raw):
        raise ValueError("the tokens do not spell the text")
    # Number of the character that each byte is part of.
    char = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80) - 1
    return char[ends - sizes[ids]] if len(ids) else ends, char[ends - 1] + 1 if len(ids) else ends


def allocate(start: np.ndarray, end: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. ``borders`` holds the sections' first characters, ascending from 0, and the end of the last."""
    n = len(borders) - 1
    first = np.searchsorted(borders, start, side="right") - 1
    last = np.searchsorted(borders, end - 1, side="right") - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float)
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(float)
    for a, b, s, e in zip(start[~inside], end[~inside], first[~inside], last[~inside], strict=True):
        held = np.minimum(borders[s + 1:e + 2], b) - np.maximum(borders[s:e + 1], a)
        if rule == "most":
            counts[s + int(np.argmax(held))] += 1
        else:
            counts[s:e + 1] += held / (b - a)
    return counts


def line_borders(text: str) -> np.ndarray:
    """Borders of the lines of a text; a final line feed ends the last line and opens no other."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    feeds = np.flatnonzero(codes == 10) + 1
    return np.concatenate([[0], feeds[feeds < len(codes)], [len(codes)]])


def count_tokens(docs: DataFrame, tokenizer: str, fields: list[str] | None = None, rule: str = "most", separator: str = "\n", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``section, start, length, n_tokens, doc_tokens`` for every section of every row.

    ``fields``: names of the columns whose values, joined by ``separator``, are the document and its sections; without
    them the sections are the lines of ``text``.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    value = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields or ["text"]]
    picked = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_keep"), F.array(*value).alias("_parts"))
    kept = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in keep)

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        sizes = encoder.token_bytes()
        for batch in stream:
            held: list[list] = [[] for _ in range(6)]

            def emit() -> pa.RecordBatch:
                rows = np.concatenate(held[0]) if held[0] else np.zeros(0, dtype=np.int64)
                whole = [np.concatenate(x) if x else np.zeros(0) for x in held[1:]]
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *(pa.array(w.astype(np.int64)) for w in whole[:3]), pa.array(whole[3].astype(float)), pa.array(whole[4].astype(np.int64))],
                    names=["_keep", "section", "start", "length", "n_tokens", "doc_tokens"])

            for row, parts in enumerate(batch.column(1).to_pylist()):
                if fields is None:
                    text = parts[0]
                    borders = line_borders(text)
                else:
                    text = separator.join(parts)
                    ends = np.cumsum([len(p) + len(separator) for p in parts])
                    borders = np.concatenate([[0], ends[:-1], [len(text)]])
                ids = encoder.array(text)
                start, end = token_spans(ids, sizes, text.encode())
                n = len(borders) - 1
                for column, values in zip(held, (np.full(n, row), np.arange(n), borders[:-1], np.diff(borders), allocate(start, end, borders, rule), np.full(n, len(ids))), strict=True):
                    column.append(values)
                if len(held[0]) >= 2000:
                    yield emit()
                    held = [[] for _ in range(6)]
            if held[0]:
                yield emit()

    out = picked.mapInArrow(count, f"_keep struct<{kept}>, section long, start long, length long, n_tokens double, doc_tokens long")
    return out.select(*(F.col("_keep").getField(c).alias(c) for c in keep), "section", "start", "length", "n_tokens", "doc_tokens")


def totals(counts: DataFrame, by: str) -> DataFrame:
    """Tokens and sections per value of ``by``."""
    return counts.groupBy(by).agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_sections"))

