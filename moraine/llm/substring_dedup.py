"""Substring dedup by content-defined chunks over a gear rolling hash.

The hash rolls over words: it shifts by 16 bits and adds the next word's gear value, so a word leaves it after four. A place is
a cut where the hash is the least of some GAP consecutive places; the start and the end of a text are cuts too. Cuts depend on
nearby words only, come at least every GAP places, and survive insertions elsewhere. A chunk runs from a cut to the first cut
at least LEAST words on, and one more from the last cut that leaves LEAST words to the end; a text of fewer words is one
chunk. So every word is in a chunk, an exact copy of a text has all its chunks, and every passage of LEAST + 2 * GAP + 3 words or
more holds a whole chunk that any other copy of the passage cuts alike. Chunks are compared by 128-bit digests of their
words: letter case (A-Z) and the white space between words do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import bounded_batches, cut_out, free_name, materialize, merged
from moraine.llm.near_dedup import mixed, word_spans

LEAST, GAP, LANE = 16, 16, 16
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        m = max(n, 1 << 15)
        _POWERS[base] = tuple(np.multiply.accumulate(np.r_[_U(1), np.full(m - 1, b, dtype=_U)]) for b in (base, pow(base, -1, 2**64)))
    up, down = _POWERS[base]
    return up[:n], down[:n]


def cut_places(words: np.ndarray) -> np.ndarray:
    """The cuts of a text of these word hashes, its start and end included."""
    n = len(words)
    if n < GAP + 3:
        return np.array([0, n])
    gear = mixed(words ^ _U(0x5851F42D4C957F2D))
    rolled = np.zeros(n, dtype=_U)
    for j in range(64 // LANE):
        rolled[j:] += gear[: n - j] << _U(j * LANE)
    rolled = rolled[3:]  # places where four words are in the hash
    view = np.lib.stride_tricks.sliding_window_view(rolled, GAP)
    return np.unique(np.r_[0, np.arange(len(view)) + view.argmin(axis=1) + 3, n])


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two signed halves of the digest, first code point, code point after the last) of every chunk of the whole text; none without words.

    The white space between a chunk and the next word belongs to it, so chunks that follow each other touch.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    start, end, words = word_spans(raw)
    n = len(words)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 4
    cuts = cut_places(words)
    a = cuts[cuts <= max(0, n - LEAST)]
    b = cuts[np.minimum(np.searchsorted(cuts, a + LEAST), len(cuts) - 1)]
    if b[-1] < n:
        a, b = np.r_[a, a[-1]], np.r_[b, n]
    halves = []
    for k, base in enumerate(_BASES):
        up, down = powers(base, n)
        sums = np.r_[_U(0), np.cumsum(mixed(words + _U(2 * k + 1)) * up, dtype=_U)]
        halves.append(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(_U)).view(np.int64))
    points = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
    stop = np.where(b < n, points[start[np.minimum(b, n - 1)]] - 1, points[end[n - 1] - 1])
    return *halves, points[start[a]] - 1, stop


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash), n_spans, n_chars, spans (start, stop in code points, joined), first_docs of the documents that repeat passages of others.

    Of the documents that share a chunk the one with the smallest id keeps it; in all others it is a repeat. Repeats
    inside one document do not count. Null texts and texts without words have no chunks, rows without an id take no part, rows that share
    an id are one document, with a result for each of its texts; extra columns are ignored; an empty table gives no rows. A digest is reduced
    in every task before the shuffle, and the join that follows is one that adaptive execution splits where a passage is in a third of all rows.
    """
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("high", "low", "start", "stop")
        for b in batches:
            got = [[dict(zip(names, c, strict=True)) for c in zip(*(x.tolist() for x in chunks(t)), strict=True)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "chunk": got})

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    stored = materialize(rows.mapInPandas(cut, "doc_id long, text_key long, chunk array<struct<high:long,low:long,start:int,stop:int>>"), "chunks")
    digests = stored.select("doc_id", F.explode("chunk").alias("c")).select("doc_id", "c.high", "c.low")
    shared = digests.groupBy("high", "low").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc").select("high", "low", "first_doc")
    shared = materialize(shared, "shared-chunks")
    each = stored.select("doc_id", "text_key", F.inline("chunk"))
    hits = each.join(shared, ["high", "low"]).where("doc_id <> first_doc")
    found = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))
    found = found.withColumn("spans", merged(F.col("spans")))
    length = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "text_key", F.size("spans").alias("n_spans"), length.alias("n_chars"), "spans", "first_docs")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of all documents but the first; no row is dropped and other texts stay as they are.

    A text that repeats others from end to end becomes empty. Null texts, rows without an id and extra columns stay as they are; rows that
    repeat an id and a text are cut alike; an empty table gives no rows.
    """
    doc, key, cut = (free_name(docs, f"span_{n}") for n in ("doc", "text", "cut"))
    spans = repeated_spans(docs, id_col, text_col).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(cut))
    text = F.col(text_col)
    joined = docs.join(spans, (F.col(id_col) == F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left")
    changed = F.when(F.col(cut).isNotNull() & text.isNotNull(), cut_out(text, F.col(cut))).otherwise(text)
    return joined.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns])
