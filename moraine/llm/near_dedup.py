"""Near-duplicate documents by min-max hashing of word shingles, confirmed on full shingle sets.

One pass makes a sketch of every row: set size, set digest and band keys of a signature that keeps the minimum and the maximum
under each permutation (two values for one hash evaluation). Rows of equal sets form a class; one node stands for
it. Nodes that share a band key are candidates. First each node is held against one candidate, the one that shares band keys
with the most others, which settles most groups with one check a node. What a band group then still holds of different components
is compared inside blocks of it, and what is open after that across blocks: the nodes of its largest component against the others,
and these against each other. Blocks are bounded by rows and by the size of their sets. Only links that join two components of a
comparison are returned, so their number stays near that of the nodes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Scratch, bounded_batches, free_name, materialize
from moraine.llm.components import components

ROWS, MISS, STRIP = 5, 1e-6, 8192
#: A block holds about so many nodes, and about so many shingles (or one larger set).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: About so many members of one band group meet its facts in one task.
DEAL = 1024
_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, 64-bit hash) of the words of text in UTF-8 (A-Z taken as a-z), all words at once."""
    low = np.frombuffer(raw.lower(), dtype=np.uint8)
    gap = np.r_[True, _SEPARATOR[low], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, dtype=_U)
    begun = np.zeros(len(low), dtype=np.int64)
    begun[start] = start
    place = (np.arange(len(low)) - np.maximum.accumulate(begun)).astype(_U)
    values = mixed(low.astype(_U) + _U(1) + mixed(place))
    values[_SEPARATOR[low]] = 0
    return start, end, mixed(np.add.reduceat(values, start) + (end - start).astype(_U))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words form one shingle, none give an empty set."""
    words = word_spans((text or "").encode("utf-8", "surrogatepass"))[2]
    if not len(words):
        return words
    k_here = min(k, len(words))
    total = np.zeros(len(words) - k_here + 1, dtype=_U)
    for j in range(k_here):
        total = total * _U(0x9E3779B97F4A7C15) + words[j : j + len(total)]
    return np.unique(mixed(total + _U(k_here)))


def bands_for(threshold: float) -> int:
    """So many bands of ROWS values that a pair at the threshold shares none with a chance below MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


@cache
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**64, n, dtype=_U), rng.integers(0, 2**63, n, dtype=_U) * _U(2) + _U(1)


def band_keys(items: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key per band over the minima and maxima under bands * ROWS / 2 permutations."""
    flip, factor = permutations(-(-bands * ROWS // 2))
    low, high = np.full(len(flip), 2**64 - 1, dtype=_U), np.zeros(len(flip), dtype=_U)
    for a in range(0, len(items), STRIP):
        h = (items[None, a : a + STRIP] ^ flip[:, None]) * factor[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    values = np.concatenate([low, high])[: bands * ROWS].reshape(bands, ROWS)
    key = mixed(np.arange(bands, dtype=_U))
    for j in range(ROWS):
        key = mixed(key ^ values[:, j]) * _U(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def link_group(nodes: list[int], parts: list[int], labels: list[int], sets: list[np.ndarray], percent: int, two_parts: bool) -> list[tuple[int, int]]:
    """Links (of different labels) that join components among the members; pairs are compared until their labels are one.

    two_parts: only members of different parts are compared.
    """
    root = {x: x for x in labels}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    home = np.array([number[x] for x in labels])
    names = list(number)
    side, size = np.array(parts), np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(universe), dtype=bool)
    out = []
    for i in range(len(nodes)):
        tops = np.array([number[top(x)] for x in names])[home]
        ok = tops != tops[i]
        ok[: i + 1] = False
        ok &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
        if two_parts:
            ok &= side != side[i]
        other = np.flatnonzero(ok)
        if not len(other):
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        mark[own] = True
        if len(other) * 4 > len(nodes):
            inter = np.add.reduceat(mark[flat].astype(np.int64), ends - size)[other]
        else:
            inter = np.array([mark[flat[ends[j] - size[j] : ends[j]]].sum() for j in other])
        mark[own] = False
        for j in other[similar(inter, size[i], size[other], percent)]:
            a, b = top(labels[i]), top(labels[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
    return out


def beside(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Members (node, key, m, ...) of band groups of m with the facts (key, m, ...; one row a group) of their group.

    A group is dealt into parts of about DEAL members, each of which meets its own copy of the facts, so no task reads a large group.
    """
    parts = F.ceil(F.col("m") / DEAL)
    dealt = members.withColumn("deal", F.pmod(F.xxhash64("node", F.lit(2)), parts))
    copied = facts.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(copied, ["key", "m", "deal"]).drop("deal")


def classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key (a hash of the text), n_shingles, component_id, kept; see near_duplicates.

    Rows that share an id but not a set of shingles are in the classes of their own sets.
    """
    spark = bounded_batches(docs.sparkSession)
    bands = bands_for(percent / 100)
    scratch = Scratch(spark)
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key.alias("text_key"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                s = shingles(t, k)
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, band_keys(s, bands) if len(s) else None))
            kinds = enumerate((pa.int32(), pa.binary(), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array([x[i] for x in out], kind) for i, kind in kinds)], ["doc_id", "text_key", "n", "digest", "bands"])

    sketched = materialize(rows.mapInArrow(sketch, "doc_id long, text_key long, n int, digest binary, bands array<long>"), "sketch")
    with_set = sketched.where("n > 0 and doc_id is not null")
    nodes = with_set.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # the number of a node is stored with it, so it stays what it is
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "of.doc_id", "of.text_key", "n", "bands"), "nodes", scratch)
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    members = (F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("low"), F.max("node").alias("high"))
    buckets = keyed.groupBy("key").agg(*members).where("m > 1")
    # of groups with the same members one is kept, with their number
    buckets = materialize(buckets.groupBy("m", "members", "low", "high").agg(F.min("key").alias("key"), F.count("*").alias("times")), "buckets", scratch)
    shared = materialize(keyed.join(buckets.select("key", "m", "times"), "key"), "members", scratch)

    near = shared.groupBy("node").agg(F.sum(F.col("m") * F.col("times")).alias("near"))
    centers = shared.join(near, "node").groupBy("key", "m").agg(F.max(F.struct("near", "node")).alias("center"))
    first = beside(shared, centers).where("node <> center.node").groupBy("node").agg(F.max("center").alias("c")).select("node", F.col("c.node").alias("center"))
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"))
    texts = rows.join(wanted, (F.col("doc_id") == F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "texts", scratch)

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        center, center_set = None, None
        for b in batches:
            out = []
            for n, c, text, center_text in zip(b["node"], b["center"], b["text"], b["center_text"], strict=True):
                if c != center:
                    center, center_set = c, shingles(center_text, k)
                x = shingles(text, k)
                inter = len(x) + len(center_set) - len(np.union1d(x, center_set))
                if similar(inter, len(x), len(center_set), percent):
                    out.append((c, n))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    pairs = first.join(texts, "node").join(texts.select(F.col("node").alias("center"), F.col("text").alias("center_text")), "center")
    links = materialize(pairs.select("node", "center", "text", "center_text").mapInPandas(confirm, "a long, b long"), "links", scratch)
    label = components(links, scratch)

    def blocks(rows: Column, size: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")

    def open_members(label: DataFrame, least: int) -> DataFrame:
        """node, label, key, blocks, rest, b_top, b_rest of the members of band groups of several components and at least so many blocks.

        rest: outside the largest component of the group; b_top, b_rest: the blocks of that component and of the rest.
        """
        left = shared.join(label, "node", "left").select("node", "n", "key", "m", F.coalesce("label", "node").alias("label"))
        held = left.groupBy("key", "m", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).groupBy("key", "m")
        held = held.agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.max(F.struct("rows", "label", "size")).alias("top"))
        rest = blocks(F.col("rows") - F.col("top.rows"), F.col("size") - F.col("top.size"))
        facts = held.where("parts > 1").select("key", "m", F.col("top.label").alias("top"), blocks(F.col("rows"), F.col("size")).alias("blocks"), blocks(F.col("top.rows"), F.col("top.size")).alias("b_top"), rest.alias("b_rest"))
        found = beside(left, facts.where(F.col("blocks") >= least))
        return materialize(found.select("node", "label", "key", "blocks", (F.col("label") != F.col("top")).alias("rest"), "b_top", "b_rest"), "open", scratch)

    def settle(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        if g["label"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        sets = [shingles(t, k) for t in g["text"]]
        found = link_group(g["node"].tolist(), g["part"].tolist(), g["label"].tolist(), sets, percent, key[1] != key[2])
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    def compared(inside: DataFrame) -> DataFrame:
        return materialize(inside.join(texts, "node").groupBy("key", "p", "q").applyInPandas(settle, "a long, b long"), "links", scratch)

    dealt = F.xxhash64("node", F.lit(1))
    left = open_members(label, 1)
    if not left.isEmpty():
        inside = left.withColumn("part", F.pmod(dealt, F.col("blocks")).cast("int"))
        links = links.union(compared(inside.select("node", "label", "key", "part", F.col("part").alias("p"), F.col("part").alias("q"))))
        label = components(links, scratch)
        left = open_members(label, 2)  # a group of one block has been compared as a whole
    if not left.isEmpty():
        part = F.when(F.col("rest"), F.pmod(dealt, F.col("b_rest"))).otherwise(F.col("b_rest") + F.pmod(dealt, F.col("b_top"))).cast("int")
        every = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("b_rest") + F.col("b_top") - 1).otherwise(F.col("b_rest") - 1))
        inside = left.withColumn("part", part).select("node", "label", "key", "part", F.explode(every).alias("other"))
        links = links.union(compared(inside.select("node", "label", "key", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))))
        label = components(links, scratch)
    named = nodes.join(label, "node", "left").select("digest", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component"))
    named = materialize(named.join(least, "label").select(F.col("digest").alias("set_digest"), "component"), "components")
    scratch.drop()
    out = sketched.select("doc_id", "text_key", "n", "digest").join(named, (F.col("digest") == F.col("set_digest")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows whose k-word shingle sets have 100 * intersection >= percent * union are linked. component_id is the smallest
    doc_id that links reach, the row's own included; kept: doc_id is component_id. Rows without words or
    text have no shingles and no links. Rows without an id have no links, a null component_id and are kept. Repeated rows
    each give a row, and are compared once; rows that share an id but not a text are linked each by its own text. Extra columns are
    ignored; an empty table gives no rows.
    """
    return classes(docs, k, percent, id_col, text_col).drop("text_key")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those of which a near duplicate with a smaller id stays.

    Rows go by id and text: a text that has no near duplicate stays, whatever else has its id. Rows that repeat a kept row stay, as do
    rows without an id, a text or words; extra columns stay as they are; an empty table gives no rows.
    """
    doc, key = (free_name(docs, f"gone_{n}") for n in ("doc", "text"))
    gone = classes(docs, k, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(gone, (F.col(id_col) == F.col(doc)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(key)), "left_anti")
