"""The training-data operators against brute force, libraries and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from moraine.llm import blocks, common, kdtree, language, near_dedup, packing, pieces, secrets, sharding, substring_dedup, tiles, token_count

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, spans string, digest string, label int"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghinorst") for _ in range(RNG.randint(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(60, 99)
SECRET = "Zk4tYw9QpLx7RmB2cVdN8sHf"
TEXTS = [
    prose(120, 1), prose(120, 1), prose(119, 1) + " other", prose(90, 3) + " " + PASSAGE + " " + prose(80, 4), prose(70, 5) + " " + PASSAGE, "", None, " ", "a", "<|endoftext|> x  y\n z",
    f"token = {SECRET} and AKIA{'A1' * 8} {'0f' * 9}", f"password: '{'q1' * 8}' secret: token=abcdefghijklmnop", f"see {SECRET}x", "日本語 😀 é ▁", "x" * 3000, prose(4000, 6),
]
ROWS = [(i, t, "en", f"s{i % 3}", 1, 1, "x", "y", 1) for i, t in enumerate(TEXTS)] + [(None, "null id text", None, None, None, None, None, None, None), (2, TEXTS[2], None, None, 1, 1, "x", "y", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def hf(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    out = packing.pack_documents(docs, BYTES, 256).collect()
    assert packing.pack_documents(empty, BYTES, 256).count() == 0
    for i, t in enumerate(TEXTS):
        ids = [*hf(t or ""), 0]
        got = sorted((r for r in out if r.doc_id == i), key=lambda r: (r.piece, r.sequence_id))
        got = got[:: 2 if i == 2 else 1]
        assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))] and sum(r.length for r in got) == len(ids)
        assert all(r.length == 256 for r in got[1:])
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for r in got)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 256
    assert len(places) <= -(-sum(r.length for r in out) // 256) + 2


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(1)
    histogram = dict(zip(*[x.tolist() for x in np.unique(np.clip(r.lognormal(6, 1, 20000).astype(int), 1, 2048), return_counts=True)], strict=True))
    slots = packing.plan_sequences(histogram, 2048)
    used = max(s[3] + s[2] - s[1] for s in slots)
    assert sum(s[2] - s[1] for s in slots) == sum(histogram.values())
    assert used <= 1.01 * sum(k * n for k, n in histogram.items()) / 2048 + 1


def test_plan_fills_a_sequence_again_with_the_same_length():
    for histogram, most in (({1100: 100, 300: 1000}, 217), ({1500: 1000, 100: 20000}, 1750), ({2048: 3, 1: 5}, 4)):
        filled: dict[int, list] = {}
        for length, rank_from, rank_to, first, offset in packing.plan_sequences(histogram, 2048):
            for k in range(rank_to - rank_from):
                filled.setdefault(first + k, []).append((offset, length))
        assert len(filled) <= most
        for places in filled.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
            assert sum(n for _, n in places) <= 2048


def plain_score(a, b):
    """The inner product of floor(256 * component) in Python integers, kept to the range of a long."""
    whole = lambda v: [int(np.floor(256 * float(x))) if abs(float(x)) < 2.0**900 else int(float(x)) * 256 for x in v]
    return min(max(sum(x * y for x, y in zip(whole(a), whole(b), strict=True)), -(2**63)), 2**63 - 1)


def searched(rows, every, k, measure):
    """Sorted (query id, rank, vec_id, score) by brute force; rows are (id, vector)."""
    out = []
    for at, (q, v) in enumerate(rows):
        if q % every == 0:
            best = sorted((-measure(v, w), i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_vector_search_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 0.3, (300, 8)).astype(np.float32)
    x[100:160] = x[50]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 8, 1), (1150, [0.0] * 8, 1), (1200, [], 1), (None, [1.0] * 8, 1), (1250, [0.5] * 3, 1), (1251, [0.25] * 3, 1)]
    rows += [(50, [float(c) for c in x[50]], 1)] * 2 + [(200, [float(c) for c in x[7]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    fit = [(i, np.array(v, dtype=np.float32)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    product = lambda a, b: float(tiles.exact_products(a[None].astype(float), b[None].astype(float))[0])
    for shard_bytes, least in ((16 << 20, 1024), (64 * 64, 40), (64 * 3, 1)):
        for method, k, measure, skip_zero in ((kdtree.TopProducts(), 5, plain_score, False), (tiles.Products(), 20, product, True)):
            got = blocks.search(df, F.col("vec_id") % 50 == 0, k, method, nonzero=skip_zero, shard_bytes=shard_bytes, least_shard=least).collect()
            assert sorted(map(tuple, got)) == searched([u for u in fit if not skip_zero or u[1].any()], 50, k, measure)
    for method in (kdtree.TopProducts(), tiles.Products()):
        assert blocks.search(df.limit(0), F.col("vec_id") % 50 == 0, 5, method).count() == 0


def test_huge_components(spark):
    r = np.random.default_rng(4)
    big = [[float(c) for c in r.normal(0, 1, 4) * 10.0 ** r.integers(-3, 12)] for _ in range(120)]
    big += [[1e300, 1.0, -1e299, 0.5], [1e300, -1e300, 1e300, 1e300], [-1e300, 2.0, 3.0, 1e299], [1e308, 0.0, 0.0, 1.0], [3e38, -3e38, 3e38, 3e38], [1e150, 1e150, 0.0, 0.0], [0.5, 0.25, -0.25, 1e-5]]
    rows = list(enumerate(big))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = blocks.search(df, F.col("vec_id") % 3 == 0, 5, kdtree.TopProducts(), shard_bytes=32 * 30, least_shard=1).collect()
    assert sorted(map(tuple, got)) == searched(rows, 3, 5, plain_score)
    near = blocks.search(df, F.col("vec_id") % 3 == 0, 5, tiles.Products(), nonzero=True).collect()
    small = [x for x in rows if max(map(abs, x[1])) < 1e100]
    assert len(near) == 5 * len([x for x in rows if x[0] % 3 == 0]) and len(small) == 122
    i, names, ids, scores = kdtree.TopProducts().search(kdtree.TopProducts().build(np.array([5, 6]), np.array([0, 1]), np.array([[1e6, 0.0], [1.0, 1.0]]), 2), np.array([9]), np.array([[1e6, 1.0]]), np.array([-(2**63)]), 2)
    assert sorted(ids.tolist()) == [5, 6] and max(scores) == int(256 * 1e6) ** 2


def test_sentencepiece(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = pieces.codec(PIECES)
    r = random.Random(4)
    for t in [t or "" for t in TEXTS] + ["".join(r.choice("abcdehtin .ñß▁\n漢<s>") for _ in range(r.randint(1, 60))) for _ in range(500)]:
        ids = model.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == model.decode(ids)
    for row in pieces.encode_decode(docs, PIECES).collect():
        if row.doc_id is not None:
            ids = model.encode(TEXTS[row.doc_id] or "")
            assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    assert pieces.encode_decode(empty, PIECES).count() == 0
    assert len(pieces.encode_column(docs.limit(1), PIECES).first().ids)


def test_large_ids_beside_nulls(spark):
    rows = [(2**60 + 1, "some words here", "en"), (None, "mots", None), (2**60 + 3, None, "en")]
    df, want = spark.createDataFrame(rows, "doc_id long, text string, lang string"), {2**60 + 1, None, 2**60 + 3}
    for out in (packing.pack_documents(df, BYTES, 64), pieces.encode_decode(df, PIECES), pieces.encode_column(df, PIECES), language.predict_languages(df, language.fit_language_model(df, F.lit(True)))):
        assert {r.doc_id for r in out.collect()} == want


def test_one_by_one_equals_rounds():
    codec = pieces.codec(PIECES)
    for t in ("thethethe", "aaaaaaaa", "international"):
        start = [codec.chars[c] for c in t]
        assert codec.one_by_one(list(start)) == codec.merge(np.array(start), np.zeros(len(t), dtype=np.int64))[0].tolist()


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
        n = min(k, len(w))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(spark, docs, empty):
    r = random.Random(8)
    base, group = prose(150, 40).split(), []
    for i in range(70):  # a loose group: copies of copies, so that links form chains
        if i:
            base = list(r.choice(group[max(0, i - 6) :]).split())
            for _ in range(r.randint(1, 4)):
                base[r.randrange(len(base))] = r.choice(WORDS)
        group.append(" ".join(base))
    rows = list(enumerate([t or "" for t in TEXTS])) + [(100 + i, t) for i, t in enumerate(group)] + [(300 + i, group[5]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 85), (5, 80)):
        want = brute_components(rows, k, percent)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, k, percent).collect()}
        assert got == want
    odd = near_dedup.near_duplicates(docs).collect()
    assert len(odd) == len(ROWS) and next(x for x in odd if x.doc_id is None).kept
    assert near_dedup.near_duplicates(empty).count() == 0
    big = [(2**60 + 1, group[0]), (2**60 + 3, group[0] + " end"), (None, group[0]), *[(2**60 + 5, group[0] + " more")] * 300]
    got = near_dedup.near_duplicates(spark.createDataFrame(big, "doc_id long, text string")).collect()
    assert len(got) == len(big) and {(x.doc_id, x.component_id) for x in got} == {(i, i and 2**60 + 1) for i, _ in big}
    kept = near_dedup.drop_near_duplicates(df)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c)


def test_link_group_blocks():
    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    assert near_dedup.link_group([1, 2, 3], [0, 0, 0], [1, 2, 3], sets, 85, False) == [(1, 2)]
    assert near_dedup.link_group([1, 2, 3], [0, 0, 1], [1, 2, 3], sets, 85, True) == []


def test_language(spark, empty):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit_language_model(docs, ~held)
    out = language.predict_languages(docs.where(held), model).where("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95 and np.mean([r.rejected for r in out]) < 0.02
    assert [model.predict(t)[0] for t in (None, "", "12 .. 34")] == ["und"] * 3
    clash = docs.limit(5).withColumn("score", F.lit("x")).withColumn("rejected", F.lit(1))
    assert language.predict_languages(clash, model).count() == 5
    nothing = language.fit_language_model(empty, F.lit(True))
    assert nothing.predict("some text") == ("und", 0.0, True) and language.predict_languages(empty, nothing).count() == 0


def test_token_counts(spark, docs, empty):
    cache = common.fresh_path(spark, "cache")
    for _ in range(2):  # the second time all are in the cache
        for r in token_count.count_tokens(docs, BYTES, cache).collect():
            if r.doc_id is not None:
                t = TEXTS[r.doc_id] or ""
                assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(hf(t)), len(hf(t)) > 512)
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{cache}/version={token_count.tokenizer_version(BYTES)}")
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_count.count_tokens(docs, PIECES, cache).where("doc_id is null").first().n_tokens > 0
    assert token_count.count_tokens(empty, BYTES, cache).count() == 0


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return sorted(out)


def test_secrets(spark, docs, empty):
    more = spark.createDataFrame([(50 + i, f"key AKIA{'B2' * 9} x token={SECRET if i else 'Ab3' * 8} é", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").union(more)
    text = {r.doc_id: r.text for r in both.collect()}
    for r in secrets.find_secrets(both).collect():
        base = brute_base(text[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[1] for x in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        if r.doc_id in range(50, 54):
            assert r.n_example >= 1  # AKIA... is held by four owners
    red = {r.doc_id: r.text for r in secrets.redact_secrets(both).collect()}
    assert "[SECRET]" in red[50] and f"AKIA{'B2' * 9}" in red[50] and red[0] == text[0] and red[6] is None
    odd = [(None, f"token={SECRET}x", "s"), (70, f"é token={SECRET}y z", "s"), (70, "another text of the same id, and clean", "t")]
    red = sorted((r.doc_id or 0, r.text) for r in secrets.redact_secrets(spark.createDataFrame(odd, "doc_id long, text string, source string")).collect())
    assert red == [(0, "[SECRET]"), (70, odd[2][1]), (70, "é [SECRET] z")]
    assert secrets.find_secrets(empty).count() == 0 and secrets.redact_secrets(empty).count() == 0


def test_secrets_guard_without_match(spark):
    texts = ["the secret: (see below)", "ends in password:", "token = ", "secret: ( then token=Ab3Ab3Ab3Ab3Ab3 and password:"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_assign, r.spans) for r in secrets.find_secrets(df).collect()}
    assert got == {0: (0, ""), 1: (0, ""), 2: (0, ""), 3: (1, "assign:15:36")}
    assert {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()} == {**dict(enumerate(texts[:3])), 3: "secret: ( then [SECRET] and password:"}


def test_shards(spark, docs, empty):
    store = sharding.ShardStore(spark, common.fresh_path(spark, "store"), target_bytes=1 << 20)
    for n in range(6):
        store.append(docs.select("doc_id", "text").repartition(3))
    assert store.read().count() == 6 * len(ROWS) and len(store.manifest()["runs"]) < 6
    stale = store.manifest()
    store.append(docs.select("doc_id", "text").limit(1))
    with pytest.raises(RuntimeError):
        store._commit(stale, [])
    assert sharding.shard_documents(empty, common.fresh_path(spark, "none")).read() is None


def test_shards_of_one_file(spark):
    store = sharding.ShardStore(spark, common.fresh_path(spark, "store"), target_bytes=1 << 20, smallest=1 << 12)
    for n in range(16):
        rows = [(n, i, hashlib.sha256(f"{n} {i}".encode()).hexdigest()) for i in range(20)]
        store.append(spark.createDataFrame(rows, "n long, doc_id long, text string").coalesce(1))
        assert len(store.manifest()["runs"]) < 2 * 4 and all(r["files"] == 1 for r in store.manifest()["runs"])
    (run,) = store.manifest()["runs"]  # four of tier 0 to one of tier 1, four of these to one of tier 2
    assert store.tier(run["bytes"]) == 2
    assert sorted((r.n, r.doc_id) for r in store.read().collect()) == [(n, i) for n in range(16) for i in range(20)]


def test_full_files_do_not_hold_up_small_ones(spark):
    store = sharding.ShardStore(spark, common.fresh_path(spark, "store"), target_bytes=1 << 12, smallest=1 << 20)
    words = lambda seed, n: spark.createDataFrame([(i, hashlib.sha256(f"{seed} {i}".encode()).hexdigest()) for i in range(n)], "doc_id long, text string").coalesce(1)
    for n in range(4):
        store.append(words(n, 80))
    assert len(store.manifest()["runs"]) == 4  # each fills its file, so nothing is to be gained
    for n in range(4, 8):
        store.append(words(n, 3))
    assert len(store.manifest()["runs"]) == 5 and store.read().count() == 4 * 80 + 4 * 3


def test_substring_dedup(spark, docs, empty):
    found = {r.doc_id: r for r in substring_dedup.repeated_spans(docs).collect()}
    assert 4 in found and found[4].first_docs == [3] and 3 not in found and 1 in found and 0 not in found
    for s in found[4].spans:
        assert TEXTS[4][s.start : s.stop] in TEXTS[3]
    cut = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs).collect()}
    assert cut[3] == TEXTS[3] and cut[15] == TEXTS[15] and len(cut[4]) < len(TEXTS[4]) and cut[6] is None
    two = spark.createDataFrame([(1, PASSAGE), (2, "x " + PASSAGE + " tail"), (2, prose(200, 77)), (None, PASSAGE)], "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in substring_dedup.drop_repeats(two).collect()]
    assert (2, prose(200, 77)) in left and (1, PASSAGE) in left and (None, PASSAGE) in left and (2, "x " + PASSAGE + " tail") not in left and len(left) == 4
    assert substring_dedup.repeated_spans(empty).count() == 0
    for seed in range(200):  # any shared passage of 51 words is met, whatever stands around it
        shared = prose(51, 1000 + seed)
        a, b = (substring_dedup.chunks(prose(40 + seed % 17, x + seed) + " " + shared + " " + prose(40, x + 7 + seed))[0] for x in (5000, 9000))
        assert set(a.tolist()) & set(b.tolist())


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    base = common.table(spark, "/root/testdata/sf0.001", "documents")
    base.write.parquet(f"{tmp_path}/documents.parquet")
    d = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d.count()
        d = common.materialize(stage(spark, d, str(tmp_path)), name)
        assert d.columns == base.columns and d.count() > 0.7 * before
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == d.count()
