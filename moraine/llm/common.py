"""Helpers shared by the training-data operators: table access, shared storage, columns over spans of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.storage import Scratch, bounded_batches, cleanup, delete, exists, fresh_path, hadoop_fs, materialize, scope, shared_dir  # noqa: F401

STRETCH = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and in whatever lambdas body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(spans: Column) -> Column:
    """Spans (start, stop) sorted by start whose stops rise too, with those that touch or overlap joined; linear in their number."""

    def join(a: Column) -> Column:
        starts = F.filter(a, lambda s, i: (i == 0) | (s["start"] > F.get(a, i - 1)["stop"]))
        lasts = F.filter(a, lambda s, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["start"] > s["stop"]))
        return F.zip_with(starts, lasts, lambda x, y: F.struct(x["start"].alias("start"), y["stop"].alias("stop")))

    return let(spans, join)


def cut_out(text: Column, spans: Column, mark: str = "") -> Column:
    """text with mark in place of each of its spans (start, stop in code points, sorted, apart from each other).

    The text is first dealt into stretches of STRETCH code points, so a span costs its length and not the way to it.
    """

    def rebuild(stretches: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / STRETCH).cast("int")
            held = F.slice(stretches, first + 1, F.greatest(F.ceil(b / STRETCH).cast("int") - first, F.lit(0)))
            return F.array_join(held, "").substr(a - first * STRETCH + 1, F.greatest(b - a, F.lit(0)))

        begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"].cast("int")))
        ends = F.concat(F.transform(spans, lambda s: s["start"].cast("int")), F.array(F.length(text)))
        return F.array_join(F.zip_with(begins, ends, piece), mark)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), rebuild)
