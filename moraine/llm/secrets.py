"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidate spans of whole texts are found by patterns. The digest of every candidate value is counted over the corpus
by distinct repositories and owners: a value that several owners or very many repositories hold is a copied example (documentation,
a tutorial), one that few hold and that looks random is a live-looking credential.

A row's matches become rows of their own and their places are running sums over these, so the work is linear in the matches of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import Scratch, cut_out, free_name, materialize

#: The patterns and least lengths of the base kinds, in the order in which ties on the start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
#: The kind that the ownership method adds: long words that mix capitals, small letters and digits, if their owners are few.
RANDOM = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: What an assignment cannot do without; cheaper to look for than the whole pattern.
ASSIGN_GUARD = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""


def matches(text: Column, kind: int, pattern: str, guard: str | None = None) -> Column:
    """(kind, values, gaps): all leftmost non-overlapping matches and the lengths of what stands before each and after the last; null without one."""
    found = F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))
    return F.when(text.rlike(guard or pattern), found)


def scan(docs: DataFrame, repository_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """row_id, doc_id, text_key (a hash), repository, owner and hits (kind, values, gaps) of every row, written to the shared folder. Null text: none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = F.array(matches(text, 0, ASSIGN, ASSIGN_GUARD), matches(text, 1, ACCESS), matches(text, 2, HEX), matches(text, 3, RANDOM))
    hits = F.filter(kinds, lambda h: h.isNotNull() & (F.size(h["values"]) > 0))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), F.xxhash64(text).alias("text_key"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), hits.alias("hits"))
    return materialize(rows, "secrets", scratch)


def spans_of(scanned: DataFrame) -> DataFrame:
    """One row per span: row_id, doc_id, text_key, repository, owner, start, kind, stop, value. Spans of the added kind are those outside all base spans."""
    keep = ["row_id", "doc_id", "text_key", "repository", "owner"]
    each = scanned.where(F.size("hits") > 0).select(*keep, F.explode("hits").alias("h"))
    each = each.select(*keep, F.col("h.kind").alias("kind"), F.posexplode(F.zip_with("h.values", "h.gaps", lambda v, g: F.struct(v.alias("value"), g.alias("gap")))).alias("pos", "m")).where("m.value is not null")
    each = each.select(*keep, "kind", "pos", F.col("m.value").alias("value"), F.col("m.gap").alias("gap")).repartition("row_id")
    so_far = Window.partitionBy("row_id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("stop", F.sum(F.col("gap") + F.length("value")).over(so_far).cast("int")).withColumn("start", F.col("stop") - F.length("value"))
    each = each.withColumn("value", F.when(F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value")))
    mixes = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    each = each.where(F.when(F.col("kind") == 0, F.length("value") >= LEAST_ASSIGNED).when(F.col("kind") == 3, mixes).otherwise(F.lit(True)))
    base = F.col("kind") < 3
    before = Window.partitionBy("row_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row_id").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("reached", F.max(F.when(base, F.col("stop"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(after))
    outside = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("stop")) >= F.col("stop"))
    return each.where(base | outside).select(*keep, "start", "kind", "stop", "value")


def classified(scanned: DataFrame, example_owners: int = 3, example_repositories: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """One row per span: row_id, doc_id, text_key, start, kind, stop, value_sha256, repositories, owners, example, live.

    example: at least `example_owners` distinct owners or `example_repositories` distinct repositories hold the value (null ones
    are not counted). live: it is no example and mixes letters and digits. Counts are exact; a value that a third of all rows
    hold is counted after it was reduced to one row per repository and owner in every task.
    """
    value = F.col("value")
    each = spans_of(scanned).select("row_id", "doc_id", "text_key", "repository", "owner", "start", "kind", "stop", F.sha2(value, 256).alias("value_sha256"), (value.rlike("[A-Za-z]") & value.rlike("[0-9]")).alias("looks_random"))
    each = materialize(each, "spans", scratch)
    held = each.groupBy("value_sha256").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))
    out = each.join(materialize(held, "ownership", scratch), "value_sha256")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    return out.select("row_id", "doc_id", "text_key", "start", "kind", "stop", "value_sha256", "repositories", "owners", example.alias("example"), (~example & F.col("looks_random")).alias("live"))


def _listed(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, repository_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3, example_repositories: int = 100, text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Base spans always stay; a span of the added kind stays if its value is live-looking. Null or empty texts have no
    spans; null ids, repositories and owners are kept; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    scanned = scan(docs, repository_col, owner_col, text_col)
    spans = classified(scanned, example_owners, example_repositories).where((F.col("kind") < 3) | F.col("live"))
    by_row = spans.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("kept"), F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"))
    out = scanned.select("row_id", "doc_id").join(by_row, "row_id", "left")
    kept = F.coalesce("kept", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    number = lambda k: F.size(F.filter("kept", lambda s: s["kind"] == k)).cast("long")
    out = out.select("doc_id", kept.alias("kept"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
    return out.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_listed(F.filter("kept", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _listed(F.col("kept")).alias("spans"), "n_live", "n_example")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", example_owners: int = 3, example_repositories: int = 100, owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with every live-looking credential replaced by `mark`; no row is dropped, widely copied examples stay.

    Redactions go by id and text: rows that share an id but not a text get their own, rows without an id theirs by the text alone.
    Overlapping spans are redacted together. Null and empty texts, repeated rows and extra columns stay as they are; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scan(docs, "doc_id", owner_col, text_col, scratch)
    place = ["doc_id", "text_key"]
    live = classified(scanned, example_owners, example_repositories, scratch).where("live").select(*place, "start", "stop").distinct()
    by = Window.partitionBy(*place).orderBy("start", "stop")
    live = live.withColumn("reached", F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    live = live.withColumn("group", F.sum(F.when(F.col("start") < F.col("reached"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    live = live.groupBy(*place, "group").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    doc, key, spans = (free_name(docs, f"live_{n}") for n in ("doc", "text", "spans"))
    live = live.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans))
    live = materialize(live, "live")
    scratch.drop()
    text = F.col(text_col)
    joined = docs.join(live, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left")
    changed = F.when(F.col(spans).isNotNull() & text.isNotNull(), cut_out(text, F.col(spans), mark)).otherwise(text)
    return joined.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns])
