"""Hashes, Bloom filters and zlib over columns, as Arrow-batched functions where no built-in gives the same bytes."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType

from moraine.storage import bounded_batches

#: Offset basis and prime of 64-bit FNV-1a; multiplier and shift of the seeded 64-bit hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MURMUR_M, MURMUR_R = 0xC6A4A7935BD1E995, 47
_MASK = 2**64 - 1


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


def fnv1a_many(items: list[bytes]) -> np.ndarray:
    """FNV-1a of all items at once, a byte place at a time; the shorter items drop out, so one long item costs its own length only."""
    size = np.array([len(x) for x in items], dtype=np.int64)
    h = np.full(len(items), FNV_BASIS, dtype=np.uint64)
    flat = np.frombuffer(b"".join(items), dtype=np.uint8).astype(np.uint64)
    by = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[by]
    left = np.searchsorted(-size[by], -np.arange(size.max(initial=0)), side="left")  # items longer than each place
    prime = np.uint64(FNV_PRIME)
    state = h[by]
    for j, n in enumerate(left.tolist()):
        state[:n] = (state[:n] ^ flat[start[:n] + j]) * prime
    h[by] = state
    return h


def seeded_hash(data: bytes, seed: int) -> int:
    """A 64-bit hash over 8-byte words and a tail, little-endian, by a seed."""
    h = (seed ^ len(data) * MURMUR_M) & _MASK
    whole = len(data) // 8 * 8
    for at in range(0, whole, 8):
        k = int.from_bytes(data[at : at + 8], "little") * MURMUR_M & _MASK
        k = (k ^ k >> MURMUR_R) * MURMUR_M & _MASK
        h = (h ^ k) * MURMUR_M & _MASK
    if tail := data[whole:]:
        h = (h ^ int.from_bytes(tail, "little")) * MURMUR_M & _MASK
    h = (h ^ h >> MURMUR_R) * MURMUR_M & _MASK
    return h ^ h >> MURMUR_R


@F.pandas_udf(LongType())
def fnv1a_64(v: pd.Series) -> pd.Series:
    got = fnv1a_many([x.encode() if isinstance(x, str) else x or b"" for x in v])
    return pd.Series(got.view(np.int64)).where(v.notna().to_numpy())


@F.pandas_udf(BinaryType())
def deflated(v: pd.Series) -> pd.Series:
    return v.map(lambda x: zlib.compress(x.encode() if isinstance(x, str) else x), na_action="ignore")


@F.pandas_udf(BinaryType())
def inflated(v: pd.Series) -> pd.Series:
    return v.map(zlib.decompress, na_action="ignore")


@F.pandas_udf(DoubleType())
def entropy(v: pd.Series) -> pd.Series:
    """Bits per byte of a value's bytes; 0 for an empty value, null for null."""

    def bits(x: str | bytes) -> float:
        n = np.bincount(np.frombuffer(x.encode() if isinstance(x, str) else x, dtype=np.uint8))
        p = n[n > 0] / max(1, n.sum())
        return float(-(p * np.log2(p)).sum()) + 0.0

    return v.map(bits, na_action="ignore").astype("float64")


def worth_compressing(values: DataFrame, payload: str = "text", least_bytes: int = 64, least_gain: float = 0.1) -> DataFrame:
    """All columns and worth: a value of at least `least_bytes` whose entropy leaves more than `least_gain` of its bits."""
    return values.withColumn("worth", (F.octet_length(payload) >= least_bytes) & ((8 - entropy(payload)) / 8 > least_gain))


def derive_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """A 256-bit key by PBKDF2 with HMAC-SHA256."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(payload: Column, key: bytes, aad: str = "") -> Column:
    """AES-256-GCM: nonce (12 bytes, random), ciphertext and tag (16 bytes); aad is authenticated with it."""
    return F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad))


def decrypted(payload: Column, key: bytes, aad: str = "") -> Column:
    """The bytes that were encrypted; null where key, aad or a byte differ."""
    return F.try_aes_decrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))


def aes_roundtrip(values: DataFrame) -> DataFrame:
    key = derive_key("correct horse", b"moraine-salt-16b")
    back = decrypted(encrypted(F.col("text"), key, "documents"), key, "documents")
    return values.where("text is not null").select("doc_id", F.sha2(back, 256).alias("sha"))


def checksums(log: DataFrame) -> DataFrame:
    return log.select("ts", fnv1a_64("v").alias("checksum"))


def zlib_roundtrip(values: DataFrame) -> DataFrame:
    bounded_batches(values.sparkSession)
    return values.where("text is not null").select("doc_id", F.sha2(inflated(deflated("text")), 256).alias("sha"))


def saving_columns(n: str, packed: str) -> list[Column]:
    """ratio, savings (not below 0), percent saved and efficiency (savings per packed byte) of values of n bytes that take packed bytes."""
    size, took = F.col(n), F.col(packed)
    saved = F.greatest(size - took, F.lit(0))
    percent = F.round(F.when(size > 0, saved * 100.0 / size).otherwise(0.0), 6)
    return [F.round(F.when(size > 0, took / size).otherwise(1.0), 6).alias("ratio"), saved.alias("savings"), percent.alias("percent"), F.round(F.when(took > 0, saved / took).otherwise(0.0), 6).alias("efficiency")]


def compression_stats(values: DataFrame) -> DataFrame:
    """Per value: sizes before and after zlib and what that saves."""
    bounded_batches(values.sparkSession)
    packed = values.where("text is not null").select("doc_id", "n", F.octet_length(deflated("text")).cast("long").alias("packed"))
    return packed.select("*", *saving_columns("n", "packed"))


def bloom_size(keys: int, wrong: float = 0.01) -> tuple[int, int]:
    """(bits, hashes), each at least 1."""
    bits = max(1, int(np.ceil(-keys * np.log(wrong) / np.log(2) ** 2))) if keys else 1
    return bits, max(1, round(bits / max(1, keys) * np.log(2)))


def seeded_hashes(items: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """seeded_hash of all items (rows) by all seeds (columns), a word place at a time."""
    size = np.array([len(x) for x in items], dtype=np.int64)
    start = np.cumsum(-(-size // 8)) - -(-size // 8)
    flat = np.frombuffer(b"".join(x.ljust(-(-len(x) // 8) * 8, b"\0") for x in items), dtype="<u8")
    m, r = np.uint64(MURMUR_M), np.uint64(MURMUR_R)
    h = seeds.astype(np.uint64)[None, :] ^ (size.astype(np.uint64) * m)[:, None]
    for j in range(-(-size.max(initial=0) // 8)):
        longer = np.flatnonzero(size > 8 * j)
        word = flat[start[longer] + j]
        k = word * m
        k = np.where(size[longer] >= 8 * j + 8, (k ^ k >> r) * m, word)  # the tail enters as it is
        h[longer] = (h[longer] ^ k[:, None]) * m
    h = (h ^ h >> r) * m
    return h ^ h >> r


@F.pandas_udf(ArrayType(LongType()))
def bloom_places(k: pd.Series, bits: pd.Series, hashes: pd.Series) -> pd.Series:
    """The bits of a filter of so many bits that a key sets."""
    most = int(hashes.max()) if len(hashes) else 0
    at = seeded_hashes([x.encode() for x in k], np.arange(most)) % bits.to_numpy().astype(np.uint64)[:, None]
    return pd.Series([row[:n] for row, n in zip(at.astype(np.int64), hashes, strict=True)])


def run_sizes(runs: DataFrame, wrong: float = 0.01) -> DataFrame:
    """(run_id, n_keys, bits, hashes) of every run of (run_id, k); null keys do not count."""
    counted = runs.where("k is not null").groupBy("run_id").agg(F.countDistinct("k").alias("n_keys"))
    bits = F.greatest(F.ceil(-F.col("n_keys") * math.log(wrong) / math.log(2) ** 2), F.lit(1)).cast("long")
    return counted.withColumn("bits", bits).withColumn("hashes", F.greatest(F.round(F.col("bits") / F.col("n_keys") * math.log(2)), F.lit(1)).cast("int"))


def words_of(keys: DataFrame) -> DataFrame:
    """Keys (k, bits, hashes, ...) with, a row each, the 64-bit words of the filter that they touch and the bit of it."""
    at = keys.withColumn("at", F.explode(bloom_places("k", "bits", "hashes")))
    return at.withColumn("word", F.shiftright("at", 6)).withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).drop("at")


def bloom_words(runs: DataFrame, wrong: float = 0.01) -> DataFrame:
    """(run_id, n_keys, bits, hashes, word, held): the words of every run's filter that are not 0. Keys are or-ed before the shuffle, and no task holds a whole filter."""
    keys = runs.where("k is not null").select("run_id", "k").join(run_sizes(runs, wrong), "run_id")
    return words_of(keys).groupBy("run_id", "n_keys", "bits", "hashes", "word").agg(F.bit_or("mask").alias("held"))


def bloom_filters(runs: DataFrame, wrong: float = 0.01) -> DataFrame:
    """(run_id, n_keys, bits, hashes, filter): the filter of every run as bytes, least bit first. Runs without a key have none."""

    @F.pandas_udf(BinaryType())
    def laid_out(words: pd.Series, held: pd.Series, bits: pd.Series) -> pd.Series:
        def one(at: np.ndarray, values: np.ndarray, n: int) -> bytes:
            full = np.zeros(-(-n // 64), dtype="<i8")
            full[at] = values
            return full.tobytes()[: -(-n // 8)]

        return pd.Series([one(*x) for x in zip(words, held, bits, strict=True)])

    whole = bloom_words(runs, wrong).groupBy("run_id", "n_keys", "bits", "hashes").agg(F.collect_list(F.struct("word", "held")).alias("w"))
    return whole.select("run_id", "n_keys", "bits", "hashes", laid_out("w.word", "w.held", "bits").alias("filter"))


def bloom_probe(runs: DataFrame, log: DataFrame) -> DataFrame:
    """(run_id, k, maybe): what each run's filter says about every key of the log. Keys meet the words that they touch, never a whole filter.

    Only the sizes of the runs, a row each, come to the driver.
    """
    sizes = [F.struct(*[F.lit(r[c]).alias(c) for c in ("run_id", "bits", "hashes")]) for r in run_sizes(runs).collect()]
    keys = log.where("k is not null").select("k").distinct()
    asked = keys.select("k", F.explode(F.array(*sizes)).alias("r")) if sizes else keys.limit(0).select("k", F.struct(F.lit(0).alias("run_id"), F.lit(0).cast("long").alias("bits"), F.lit(0).alias("hashes")).alias("r"))
    held = bloom_words(runs).select("run_id", "word", "held")
    met = words_of(asked.select("k", "r.*")).join(held, ["run_id", "word"], "left")
    return met.groupBy("run_id", "k").agg(F.every(F.coalesce(F.col("held").bitwiseAND(F.col("mask")) != 0, F.lit(False))).alias("maybe"))
