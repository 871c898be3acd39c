"""Token counts with a digest cache: only contents that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.bpe import encoder
from moraine.llm.common import bounded_batches, exists, materialize

CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the versions of the libraries that read it: counts of another version are never reused."""
    import sentencepiece
    import tiktoken
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__} tiktoken {tiktoken.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + f.read()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Content is normalised to what the tokenizer sees: null becomes empty, the text is its UTF-8 bytes. cache is a
    folder of Parquet files by tokenizer version that this call reads and appends to; deleting it only costs time.
    Every call appends in a folder of its own, so writers do not disturb each other, and what a lost one leaves is right as far as it goes.
    Null ids stay null, repeated rows give repeated rows, an empty table gives none. Other columns are ignored.
    Texts are shuffled once, after one copy per digest and task was kept, so a content that fills a third of all rows
    costs one row a task. Of the cache only the rows of contents at hand are reduced; the join back is on small rows,
    which adaptive execution splits where a digest is hot.
    """
    spark = bounded_batches(docs.sparkSession)
    store = f"{cache.rstrip('/')}/version={tokenizer_version(tokenizer)}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    stored = lambda: spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(store)
    misses = rows.select("digest", "text").dropDuplicates(["digest"])
    warm = exists(spark, store)
    if warm:
        misses = misses.join(stored().select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": list(map(encoder(tokenizer).count, b["text"]))})

    misses.mapInPandas(encode, CACHE_SCHEMA).write.parquet(f"{store}/call-{uuid.uuid4().hex}")
    found = stored()
    if warm:
        found = found.join(rows.select("digest").distinct(), "digest", "left_semi")
    counts = materialize(found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")  # two writers may both have added a content
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
