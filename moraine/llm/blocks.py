"""A stated query set against all rows, in blocks: blocks of queries meet shards of rows, each packed into one row of bounded size.

Shards are built once and stored with what the search needs of them (trees, codes). One shard, a random part of all rows, is
searched first; every query's kth best score there goes with it to all other shards, which give only what can still be among the best.
"""

from __future__ import annotations

import pickle
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import Scratch, bounded_batches, materialize


class Method(Protocol):
    score: str  # the type of a score

    def build(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> object:
        """What a shard stores. ids: vec_ids, rows: distinct row numbers."""

    def search(self, shard: object, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row, vec_id, score) of at least those rows of the shard that can be among the k best of each query, its own row left out.

        least: for each query a score that k rows elsewhere reach at least, or the least possible one.
        """

    def lowest(self) -> float | int:
        """The least possible score."""


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Not null, not empty, no null or non-finite component (and not all zero)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    return ok & F.exists(vector, lambda x: x != 0) if nonzero else ok


def search(vectors: DataFrame, queries: Column, k: int, method: Method, nonzero: bool = False, shard_bytes: int = 16 << 20, least_shard: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query row, ties to the smaller vec_id.

    Candidates are all usable rows but the query's own row, so a repeated row stays a candidate; every query row has a
    result of its own, repeated ones too. Rows without an id take no part, and only vectors of the query's length are compared.
    Other columns are ignored; an empty table gives no rows. A shard and a block of queries hold about `shard_bytes` of doubles each, a shard
    less where that keeps all cores busy, but not under `least_shard` rows. Rows are dealt by a hash of their number, which is stored with
    them, so repeated vectors or ids do not gather and a lost task deals as before.
    """
    spark, v, scratch = vectors.sparkSession, F.col(vector_col), Scratch(vectors.sparkSession)
    bounded_batches(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v, nonzero))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"), F.coalesce(queries, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "vectors", scratch)
    n, q, dim = rows.agg(F.count("*"), F.count_if("asked"), F.coalesce(F.max("dim"), F.lit(1))).first()
    fits = max(1, shard_bytes // (8 * dim))
    shards = max(1, -(-n // min(fits, max(least_shard, n // (3 * spark.sparkContext.defaultParallelism)))))
    blocks = max(1, -(-q // fits))
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every = lambda m, first=0: F.explode(F.sequence(F.lit(first), F.lit(m - 1)))
    hit = f"row long, hit_row long, vec_id long, score {method.score}"
    names = [x.split()[0] for x in hit.split(", ")]

    def build(g: pd.DataFrame) -> pd.DataFrame:
        made = method.build(g["vec_id"].to_numpy(), g["row"].to_numpy(), np.stack(g["v"].to_list()), k)
        return pd.DataFrame({"shard": g["shard"].iloc[:1], "dim": g["dim"].iloc[:1], "made": [pickle.dumps(made, protocol=5)]})

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        packed = pickle.dumps((g["row"].to_numpy(), np.stack(g["v"].to_list())), protocol=5)
        return pd.DataFrame({"block": g["block"].iloc[:1], "dim": g["dim"].iloc[:1], "asked": [packed]})

    def meet(asked: bytes, made: bytes, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        query_rows, matrix = pickle.loads(asked)
        floor = np.full(len(query_rows), method.lowest()) if least is None else least
        i, hit_rows, ids, scores = method.search(pickle.loads(made), query_rows, matrix, floor, k)
        return query_rows[i], hit_rows, ids, scores

    def first_shard(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [meet(asked, made, None) for asked in a["asked"] for made in b["made"]]
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)) if out else {c: [] for c in names})

    def other_shards(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for asked, known in zip(a["asked"], a["known"], strict=True):
            query_rows = pickle.loads(asked)[0]
            have = {} if known is None else {x["row"]: x["kth"] for x in known}
            least = np.array([have.get(r, method.lowest()) for r in query_rows.tolist()])
            out += [meet(asked, made, least) for made in b["made"]]
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)) if out else {c: [] for c in names})

    stored = rows.withColumn("shard", deal(shards)).groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, made binary")
    stored = materialize(stored, "shards", scratch)
    asked = rows.where("asked").withColumn("block", deal(blocks)).groupBy("block", "dim").applyInPandas(gather, "block int, dim int, asked binary")
    asked = materialize(asked, "queries", scratch)

    sides = asked.groupBy("block", "dim").cogroup(stored.where("shard = 0").withColumn("block", every(blocks)).groupBy("block", "dim"))
    found = materialize(sides.applyInPandas(first_shard, hit), "first-hits", scratch)
    if shards > 1:
        kth = found.groupBy("row").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("scores")).where(F.col("n") >= k).select("row", F.get("scores", F.lit(k - 1)).alias("kth"))
        known = kth.withColumn("block", deal(blocks)).groupBy("block").agg(F.collect_list(F.struct("row", "kth")).alias("known"))
        left = asked.join(known, "block", "left").withColumn("shard", every(shards, 1))
        right = stored.where("shard > 0").withColumn("block", every(blocks))
        key = ["shard", "block", "dim"]
        rest = materialize(left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(other_shards, hit), "hits", scratch)
        found = found.unionByName(rest)
    by = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    out = materialize(best.join(rows.where("asked").select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score"), "nearest")
    scratch.drop()
    return out
