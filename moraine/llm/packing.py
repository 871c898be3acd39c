"""Best-fit packing by length patterns: non-negative least squares on the length histogram, then best fit for the rest."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.bpe import encoder
from moraine.llm.common import bounded_batches, free_name, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "slot_length long, rank_from long, rank_to long, first_sequence long, slot_offset long"


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of at most `capacity` ids of every document; only longer documents are cut, and then the first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encoder(tokenizer).ids(text or "") + end
                n = len(ids) // 4
                bounds = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                out += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False))]
            kinds = zip(("doc_id", "piece", "start", "length", "ids_crc32"), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)
            yield pa.RecordBatch.from_pydict({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate(kinds)})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def length_pairs(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, 0) of all two lengths at hand that fill a sequence exactly."""
    have = np.flatnonzero(counts)
    have = have[(have > 0) & (2 * have <= capacity)]
    have = have[counts[capacity - have] > 0]
    return np.stack([have, capacity - have, np.zeros_like(have)], axis=1)


def priced_triples(counts: np.ndarray, lack: np.ndarray, capacity: int, each: int = 4, rows: int = 256) -> np.ndarray:
    """Rows a <= b <= c of lengths at hand that fill a sequence exactly: for every a the `each` with the largest sum of lack above zero.

    All triples are looked at, `rows` lengths at a time, so memory is bounded by the capacity.
    """
    have = np.flatnonzero(counts)
    have = have[have > 0]
    out = [np.zeros((0, 3), dtype=np.int64)]
    for a in np.split(have, range(rows, len(have), rows)):
        c = capacity - a[:, None] - have[None, :]
        ok = (a[:, None] <= have[None, :]) & (have[None, :] <= c)
        ok[ok] = counts[c[ok]] > 0
        worth = np.where(ok, lack[a][:, None] + lack[have][None, :] + lack[np.maximum(c, 0)], -np.inf)
        best = np.argpartition(-worth, min(each, worth.shape[1]) - 1, axis=1)[:, :each]
        i, j = np.repeat(np.arange(len(a)), best.shape[1]), best.ravel()
        good = worth[i, j] > 1e-3
        out.append(np.stack([a[i[good]], have[j[good]], c[i[good], j[good]]], axis=1))
    return np.concatenate(out)


def nnls_repeats(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative repeats of the patterns whose use of the lengths is nearest to the histogram, and what they lack of it: projected gradient with momentum."""
    target = counts.astype(float).copy()
    target[0] = 0
    used = lambda x: np.bincount(patterns.ravel(), np.repeat(x, 3), minlength=len(counts))
    weight = used(np.ones(len(patterns)))
    step = 1.0 / (3 * max(1.0, weight[1:].max(initial=1.0)))
    x = y = start
    t = 1.0
    for _ in range(rounds):
        miss = used(y) - target
        miss[0] = 0
        new = np.maximum(0, y - step * miss[patterns].sum(axis=1))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    lack = target - used(x)
    lack[0] = 0
    return x, lack


def fitted_patterns(counts: np.ndarray, capacity: int, most_rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats): non-negative least squares over all patterns of two or three lengths that fill a sequence.

    All pairs take part from the start; triples enter once they would lower the miss, until none does (the optimum over all triples)
    or `most_rounds` fits were made, each from where the one before ended.
    """
    patterns, repeats = length_pairs(counts, capacity), np.zeros(0)
    lack = counts.astype(float)
    for n in range(most_rounds):
        more = priced_triples(counts, lack, capacity)
        key = lambda p: p[:, 0] * (capacity + 1) + p[:, 1]
        more = more[~np.isin(key(more), key(patterns))]
        if not len(more) and n:
            break
        patterns = np.concatenate([patterns, more])
        if not len(patterns):
            break
        repeats, lack = nnls_repeats(patterns, counts, np.r_[repeats, np.zeros(len(patterns) - len(repeats))], 150)
    return patterns, repeats


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank_from, rank_to, first_sequence, offset): the pieces of that length with these ranks go to consecutive sequences.

    The fitted repeats are rounded down and trimmed to what the histogram holds. Residual lengths follow in
    falling order, each into the fullest open sequences that still take it. The work depends on the capacity only.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    slots, taken, sequences = [], np.zeros(capacity + 1, dtype=np.int64), 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        slots.append((length, int(taken[length]), int(taken[length]) + n, first, offset))
        taken[length] += n

    if counts[capacity]:
        n = int(counts[capacity])
        place(capacity, n, 0, 0)
        sequences = n
    left = counts.copy()
    left[capacity] = 0
    patterns, repeats = fitted_patterns(left, capacity)
    if len(patterns):
        repeats = np.floor(repeats + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] <= 0:
                break
            lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            n = int(min(repeats[k], (left[lengths] // times).min()))
            if n > 0:
                offset = 0
                for length in patterns[k][patterns[k] > 0]:
                    place(int(length), n, sequences, offset)
                    offset += int(length)
                    left[length] -= n
                sequences += n
    space: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids: (first sequence, how many)
    for length in range(capacity - 1, 0, -1):
        n, free = int(left[length]), length
        while n and free < capacity:
            if not space[free]:
                free += 1
                continue
            first, have = space[free].pop()
            use = min(n, have)
            place(length, use, first, capacity - free)
            if use < have:
                space[free].append((first + use, have - use))
            if free > length:
                space[free - length].append((first, use))
            n -= use
            if free >= 2 * length:  # what is left takes the same length again, and fits it better
                free -= length
        each = capacity // length
        for per, m in ((each, n // each), (n % each, 1)):
            if per and m:
                for k in range(per):
                    place(length, m, sequences, k * length)
                if capacity > per * length:
                    space[capacity - per * length].append((sequences, m))
                sequences += m
    return slots


def pack(pieces: DataFrame, capacity: int, rows_per_bucket: int = 200_000) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ...) of 1 to `capacity` ids.

    Only the histogram (at most `capacity` rows) comes to the driver and only the plan's slots, bounded likewise, are
    broadcast. Pieces are stored with a number each; a length that a third of all pieces share is ranked in buckets of these numbers
    with offsets, not in one task, and repeated rows do not gather. Null doc_ids and repeated rows are pieces like any other; other
    columns stay; no pieces give no rows.
    """
    spark, row = pieces.sparkSession, free_name(pieces, "row")
    stored = materialize(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    slots = F.broadcast(spark.createDataFrame(plan_sequences(histogram, capacity), SLOTS))
    buckets = max(16, -(-sum(histogram.values()) // rows_per_bucket))
    dealt = stored.select("length", F.col(row).alias("row_number"), F.struct(*pieces.columns).alias("piece_of")).withColumn("bucket", F.pmod(F.xxhash64("row_number"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").count().select(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("row_number")
    ranked = dealt.withColumn("nth", F.row_number().over(within) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket"))).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select("piece_of.*", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), F.col("slot_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts (null: empty), end each document with end_id, and pack all pieces into sequences of at most `capacity` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; a sequence is gapless from offset 0.
    Null doc_ids are kept, repeated rows are packed as often as they occur, extra columns are ignored; an empty table gives no rows.
    """
    return pack(tokenize_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
