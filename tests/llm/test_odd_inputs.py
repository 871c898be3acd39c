"""Long, repeated, clashing and lost inputs of the training-data operators, and plain versions of what SQL cannot express."""

import math
import random
import time
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moraine.llm import bpe, common, language, near_dedup, packing, queries, secrets, sharding, substring_dedup, token_count
from test_ops import BYTES, SECRET, WORDS, brute_base, brute_components, hf, prose


def test_long_white_space(spark):
    texts = [pre + ch * n + post for ch in " \n　" for n in (999, 1000, 40_000) for pre in ("", "ab") for post in ("", "b", "'s", " <|endoftext|>")] + ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000 + "b"]
    fast = bpe.encoder(BYTES)
    for t in texts:
        ids = array("I")
        ids.frombytes(fast.ids(t))
        assert ids.tolist() == hf(t) and fast.count(t) == len(ids)
    df = spark.createDataFrame([(1, texts[-1]), (2, texts[-2]), (None, "x"), (None, "x")], "doc_id long, text string")
    pieces = packing.pack_documents(df, BYTES, 2048).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == len(hf(texts[-1])) + 1 and sum(r.doc_id is None for r in pieces) == 2


def test_pattern_fit_is_the_optimum_over_all_patterns():
    counts = np.zeros(65, dtype=np.int64)
    for n in np.random.default_rng(2).integers(1, 64, 4000):
        counts[n] += 1
    patterns, repeats = packing.fitted_patterns(counts, 64, most_rounds=40)
    used = np.bincount(patterns.ravel(), np.repeat(repeats, 3), minlength=65)
    lack = counts - used
    lack[0] = 0
    worst = max(lack[a] + lack[b] + lack[64 - a - b] for a in range(1, 64) for b in range(a, 64) if b <= 64 - a - b)
    assert worst < 1.0 and (patterns.sum(axis=1) == 64).all()


def test_token_query_over_a_stored_cache(spark):
    spark.conf.set("moraine.tokenCache", common.fresh_path(spark, "kept-cache"))
    try:
        one = sorted(map(tuple, queries.op6_token_counts(spark, "/root/testdata/sf0.001").collect()))
        store = f"{spark.conf.get('moraine.tokenCache')}/version={token_count.tokenizer_version(BYTES)}"
        held = lambda: spark.read.option("recursiveFileLookup", "true").parquet(store).count()
        n = held()
        assert sorted(map(tuple, queries.op6_token_counts(spark, "/root/testdata/sf0.001").collect())) == one and held() == n
    finally:
        spark.conf.unset("moraine.tokenCache")


def plain_features(text):
    """Hashed runs of 1 to 4 characters of the lower-cased text, other characters than letters as single spaces, padded by one."""
    out, low = [], "".join(c if c.isalpha() else " " for c in text.lower())
    padded = [" ", *low, " "]
    c = [x for i, x in enumerate(padded) if i == 0 or x != " " or padded[i - 1] != " "]
    for n in language.ORDERS:
        for i in range(len(c) - n + 1):
            run = c[i : i + n]
            if " " in run[1:-1] or (n <= 2 and run[0] == run[-1] == " "):
                continue
            h = n * 0x165667B1 & 0xFFFFFFFF
            for k, x in enumerate(run):
                h = (h ^ ord(x)) * int(language._MIX[k]) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % language.BUCKETS)
    return out


def test_language_against_a_plain_version(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = language.fit_language_model(docs, F.lit(True))
    for r in language.predict_languages(docs.limit(40), model).collect():
        f = plain_features(r.text or "")
        if not f:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        z = [(sum(float(model.table[i, k]) for i in f) / len(f) + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
        e = [math.exp(x - max(z)) for x in z]
        assert r.lang_pred == model.langs[e.index(max(e))] and abs(r.score - max(e) / sum(e)) < 1e-6
        assert r.rejected == (len(f) >= language.JUDGED and r.score < model.threshold)


def test_every_language_is_learned(spark):
    french = ["bonjour le monde et merci beaucoup", *[f"le chat numero {i} est dans la maison avec nous" for i in range(20)]]
    rows = [(french[0], "fr")] * 6000 + [(t, "fr") for t in french[1:]] + [(f"the cat number {i} is in the house with us", "en") for i in range(1500)]
    model = language.fit_language_model(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    assert model.langs == ("en", "fr") and model.predict("bonjour le monde")[0] == "fr" and model.predict("the house with us")[0] == "en"
    letters = [chr(0x4E00 + 40 * i) for i in range(260)]
    many = spark.createDataFrame([("".join(random.Random(j).choice([c, chr(ord(c) + 1), " "]) for _ in range(60)) + c, f"l{i:03d}") for i, c in enumerate(letters) for j in range(6)], "text string, lang string")
    model = language.fit_language_model(many, F.lit(True), sample_rows=1600)
    assert len(model.langs) == 260 and np.mean([model.predict(c * 9)[0] == f"l{i:03d}" for i, c in enumerate(letters)]) > 0.8
    names = ("x1", "x2", "x3")
    kept = language.predict_languages(many.limit(3).withColumn("score", F.lit(42.0)), model, names=names)
    assert {r.score for r in kept.collect()} == {42.0} and set(names) < set(kept.columns)


def test_many_matches_in_one_text(spark):
    runs = " ".join(f"{i:016x}" for i in range(100_000))
    rows = [(1, runs, None), (2, "enter your password:", None), (3, f"token={SECRET}", None), *[(10 + i, f"x AKIA{'C3' * 9}", None) for i in range(100)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert time.time() - began < 60 and got[1].n_hex == 100_000 and got[2].spans == "" and got[3].n_live == 1
    assert got[1].spans.startswith("hex:0:16,hex:17:33") and got[1].spans.endswith(f"hex:{17 * 99_999}:{17 * 99_999 + 16}")
    assert got[10].n_example == 1  # a hundred repositories without an owner
    red = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert red[1].count("[SECRET]") == sum(any(c in "abcdef" for c in f"{i:016x}") for i in range(100_000)) and red[10] == rows[3][1]


def test_random_texts_of_secrets(spark):
    r = random.Random(12)
    bits = ["token=", "password: ", f"'{SECRET}'", "AKIA" + "Q7" * 8, "0f" * 9, " ", "\n", "é", "😀", "secret =", "x", "=", "api_key", SECRET, "ab12" * 5]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 30))), f"s{i % 2}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for row in secrets.find_secrets(df).collect():
        base = brute_base(rows[row.doc_id][1])
        listed = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [x for x in row.spans.split(",") if x and not x.startswith("random")] == listed
        for x in row.spans.split(","):
            if x.startswith("random"):
                s, e = map(int, x.split(":")[1:])
                assert all(e <= b or d <= s for b, _, d in base)


def test_versions_of_a_store(spark):
    root = common.fresh_path(spark, "store")
    store = sharding.ShardStore(spark, root, target_bytes=1 << 20)
    rows = lambda n: spark.createDataFrame([(n, "x")], "doc_id long, text string").coalesce(1)
    for n in range(3):
        store.append(rows(n))
    before = store.manifest()
    old = store.read(before["version"])
    store.append(rows(3))
    assert len(store.manifest()["runs"]) == 1 and old.count() == 3 and store.read(before["version"]).count() == 3
    other = sharding.ShardStore(spark, root, target_bytes=1 << 20)
    stale = other.manifest
    calls = []
    other.manifest = lambda version=None: before if not calls and not calls.append(1) else stale(version)  # one look at an old version
    other.append(rows(4))
    assert sorted(r.doc_id for r in store.read().collect()) == [0, 1, 2, 3, 4]
    last = store.versions()[-1]
    assert last in store.vacuum(3600) and store.read(before["version"]).count() == 3
    assert store.vacuum(-1) == [last] and sorted(r.doc_id for r in store.read().collect()) == [0, 1, 2, 3, 4]
    clash = spark.createDataFrame([(1, "t", 42), (None, None, 43)], "doc_id long, text string, arrival int")
    got = sharding.shard_documents(clash, common.fresh_path(spark, "store")).read()
    assert sorted(r.arrival for r in got.collect()) == [42, 43] and got.columns == clash.columns


def plain_chunks(text):
    """Chunks as lists of words by the rule in words: cuts where the rolled hash is least among GAP places, and at both ends."""
    words = (text or "").lower().split()
    hashes = near_dedup.word_spans((text or "").encode())[2].tolist()
    n, m64 = len(words), 2**64
    gear = [int(near_dedup.mixed(np.array([h ^ 0x5851F42D4C957F2D], dtype=np.uint64))[0]) for h in hashes]
    rolled, h = {}, 0
    for i in range(n):
        h = ((h << 16) + gear[i]) % m64
        rolled[i] = h
    cuts = {0, n}
    for i in range(3, n - substring_dedup.GAP + 1):
        cuts.add(min(range(i, i + substring_dedup.GAP), key=lambda p: (rolled[p], p)))
    cuts, out = sorted(cuts), []
    for a in [c for c in cuts if c <= max(0, n - substring_dedup.LEAST)]:
        out.append((a, next((c for c in cuts if c >= a + substring_dedup.LEAST), n)))
    if out and out[-1][1] < n:
        out.append((out[-1][0], n))
    return [(a, b, tuple(words[a:b])) for a, b in out if b > a]


def plain_repeats(rows):
    """{(doc_id, text): set of repeated word places} by comparing the words of chunks."""
    first, out = {}, {}
    for i, t in rows:
        for _, _, c in plain_chunks(t):
            first[c] = min(first.get(c, i), i)
    for i, t in rows:
        for a, b, c in plain_chunks(t):
            if first[c] < i:
                out.setdefault((i, t), set()).update(range(a, b))
    return out


def test_chunks_against_a_plain_version(spark):
    shared = [prose(n, 500 + n) for n in (20, 55, 70, 130)]
    r = random.Random(9)
    rows = []
    for i in range(60):
        parts = [prose(r.randint(1, 60), 900 + i), *r.sample(shared, r.randint(0, 2)), prose(r.randint(0, 40), 1900 + i)]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1].replace(" ", "\n ")) for i in range(10)] + [(200, "two words"), (201, "Two  words"), (202, "é"), (203, "é"), (204, ""), (205, None), (206, " \n")]
    want = plain_repeats(rows)
    text = dict(rows)
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {i for i, _ in want} and {201, 203} <= set(got) and not {204, 205, 206} & set(got)
    for i, row in got.items():
        words, at = [], 0
        for w in text[i].split():
            at = text[i].index(w, at)
            words.append((at, at + len(w)))
            at += len(w)
        assert {k for k, (s, e) in enumerate(words) if any(x.start <= s and e <= x.stop for x in row.spans)} == want[i, text[i]]
    for i in range(100, 110):  # an exact copy is found from end to end
        assert [(x.start, x.stop) for x in got[i].spans] == [(0, len(text[i]))]


def test_shared_ids_and_large_loose_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    monkeypatch.setattr(near_dedup, "STRIP", 64)
    base, r, rows = prose(150, 70).split(), random.Random(6), []
    for i in range(60):
        words = list(base)
        for at in r.sample(range(150), 4):
            words[at] = r.choice(WORDS)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, 3, 85).collect()} == brute_components(rows, 3, 85)
    lone = prose(90, 71)
    both = spark.createDataFrame([(1, "a " + " ".join(base)), (5, " ".join(base)), (5, lone)], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.drop_near_duplicates(both).collect())) == [(1, "a " + " ".join(base)), (5, lone)]


def test_members_of_band_groups_meet_facts_three_times_at_most(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    base, r, rows = prose(150, 72).split(), random.Random(7), []
    for i in range(50):  # a loose group, open to the end
        words = list(base)
        for at in r.sample(range(150), 4):
            words[at] = r.choice(WORDS)
        rows.append((i, " ".join(words)))
    for i in range(10):  # pairs that share many bands
        rows += [(100 + i, prose(120, 80 + i)), (200 + i, prose(120, 80 + i) + " end")]
    made, beside = [], near_dedup.beside

    def counted(members, facts):
        made.append(beside(members, facts).count())
        return beside(members, facts)

    monkeypatch.setattr(near_dedup, "beside", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, 3, 85).collect()} == brute_components(rows, 3, 85)
    groups = {}
    for i, t in rows:
        for key in near_dedup.band_keys(near_dedup.shingles(t, 3), near_dedup.bands_for(0.85)).tolist():
            groups.setdefault(key, set()).add(i)
    held = [g for g in groups.values() if len(g) > 1]
    assert made[0] == sum(map(len, set(map(frozenset, held)))) < sum(map(len, held)) and len(made) <= 3 and made[-1] > 0


def test_cut_out_of_long_texts(spark):
    r, rows = random.Random(3), []
    for n in (0, 1, 1023, 1024, 1025, 5000):
        t = "".join(r.choice("ab é😀\n") for _ in range(n))
        edges = sorted(r.sample(range(n + 1), min(n + 1, 8) // 2 * 2))
        rows.append((t, [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,stop:int>>").select(common.cut_out(F.col("text"), F.col("spans"), "#").alias("out"))
    for (t, spans), row in zip(rows, df.collect(), strict=True):
        for a, b in reversed(spans):
            t = t[:a] + "#" + t[b:]
        assert row.out == t


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage on what the one before kept, against a plain version of it, with planted copies, passages, secrets and odd rows."""
    passage = prose(60, 300)
    texts = [prose(80, 200 + i) for i in range(12)]
    texts += [texts[0], texts[1] + " more", prose(60, 310) + " " + passage, passage + " " + prose(60, 311), f"{prose(40, 312)} token={SECRET} end", "enter your password:", "plain words", "", None, "12 34", "\n" * 5000 + "x"]
    rows = [(i, t, "en", "s", 7, 42.0, "mine") for i, t in enumerate(texts)] + [(3, prose(70, 320), "en", "s", 7, 42.0, "mine")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), docs
    pairs = lambda d: sorted((r.doc_id, r.text) for r in d.collect())
    has_letters = lambda t: any(c.isalpha() for c in t or "")

    kept = common.materialize(stages["language_id"](spark, kept, ""), "t")
    assert kept.columns == docs.columns and {(r.score, r.rejected) for r in kept.collect()} == {(42.0, "mine")}
    assert pairs(kept) == sorted((i, t) for i, t, *_ in rows if has_letters(t))
    now = pairs(kept)

    kept = common.materialize(stages["near_dedup"](spark, kept, ""), "t")
    numbered = list(enumerate(now))  # by id and text: a number for each row, in the order of ids
    least = brute_components([(n, t) for n, (_, t) in numbered], 5, 80)
    assert pairs(kept) == [x for n, x in numbered if least[n][1] == n]
    now = pairs(kept)

    kept = common.materialize(stages["substring_dedup"](spark, kept, ""), "t")
    repeats = plain_repeats(now)
    for (i, t), (j, u) in zip(now, pairs(kept), strict=True):
        gone = repeats.get((i, t), set())
        assert i == j and u.split() == [w for k, w in enumerate(t.split()) if k not in gone] and (gone or u == t)
    assert repeats
    now = pairs(kept)

    kept = common.materialize(stages["secret_scan"](spark, kept, ""), "t")
    assert pairs(kept) == sorted((i, t.replace(f"token={SECRET}", "[SECRET]")) for i, t in now)
    now = pairs(kept)

    packed = stages["pattern_packing"](spark, kept, "").collect()
    assert sum(r.length for r in packed) == sum(len(hf(t)) + 1 for _, t in now)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, ran.collect())) == sorted(map(key, packed))
    nothing = common.fresh_path(spark, "nothing")
    docs.limit(0).write.parquet(f"{nothing}/documents.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_all_queries_are_registered():
    import __spark_entry__

    assert len([n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()]) == 11
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTES
    with pytest.raises(KeyError):
        dict(corpus_pipeline.STAGES)["none"]
