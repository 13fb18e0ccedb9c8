"""Learned scores by held-out accuracy; secrets by brute force; shards by round trip."""

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from loreweave.llm import language, quality, secret_scan, toxicity
from loreweave.llm.folds import bounded_sample
from loreweave.llm.language import Profiler, identify
from loreweave.llm.quality import score_quality
from loreweave.llm.secret_scan import find_secrets
from loreweave.llm.sharding import Conflict, Run, ShardStore, shard_table
from loreweave.operators import skew
from loreweave.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.1"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def is_held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def auc(score, label):
    score, label = np.array(score), np.array(label)
    pairs = score[label == 1][:, None] - score[label == 0][None, :]
    return (pairs > 0).mean() + 0.5 * (pairs == 0).mean()


def table(spark, rows, columns="doc_id long, text string, lang string, score double, label int"):
    return spark.createDataFrame([(i, t, g, 0.5, 1) for i, t, g in rows], columns)


ODD = [(1, None, "en"), (2, "", "de"), (3, "123 !!", None), (4, "x" * 2_000_000, "en"), (4, "twice", "en"), (None, "no id", "fr")]


# -- language ----------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    docs = documents(spark)
    got = identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert rows[0] > 0.99 and 0 <= rows[1] and rows[2] <= 1


def test_language_odd_rows(spark):
    docs = table(spark, [*ODD, *((100 + i, "the cat sat on the mat", "en") for i in range(20)), *((200 + i, "der hund und die katze", "de") for i in range(20))])
    got = {(r["doc_id"], r["lang_pred"]): r for r in identify(spark, docs).collect()}
    for i in (1, 2, 3):
        assert got[i, "und"]["score"] == 0
    assert (100, "en") in got and (200, "de") in got and all(r["held_out"] == is_held_out(i) for (i, _), r in got.items())
    assert identify(spark, docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_profile(text, dimensions):
    """Trigrams of lower-case letters and blanks, one by one."""
    letters = [0]
    for c in text:
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or letters[-1]:
            letters.append(x)
    if letters[-1]:
        letters.append(0)
    vector = lambda x: language.letter_vectors(np.array([x]), dimensions)[0].astype(int)
    out = np.zeros(dimensions, dtype=int)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


@pytest.mark.parametrize("segment", [1 << 18, 7])
def test_profiles_equal_brute_force(monkeypatch, segment):
    monkeypatch.setattr(language, "SEGMENT", segment)
    monkeypatch.setattr(language, "AT_ONCE", 5)
    monkeypatch.setattr(language, "KEPT", 12)
    texts = ["Ab-c", "", "!?", "Ж и ד 中文字", "a", "hello wörld -- long  text " * 4, None]
    profiler = Profiler(64)
    for _ in range(2):
        x, lettered, trigrams = profiler.measured(texts)
        assert [v.tolist() for v in x.astype(int)] == [brute_profile(t or "", 64).tolist() for t in texts]
        assert lettered.tolist() == [True, False, False, True, True, True, False]
    assert trigrams.tolist()[:3] == [4, 0, 0]
    vectors = language.letter_vectors(np.arange(3000), 64)
    assert len({v.tobytes() for v in vectors}) == 3000  # every letter of every script has its own


def test_predictions_equal_brute_force(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("кот и пёс", "ru")] * 12)]
    docs = table(spark, rows)
    sums = {}
    for i, t, g in rows:
        if not is_held_out(i):
            x = brute_profile(t, 512)
            sums[g] = sums.get(g, 0) + x / np.linalg.norm(x)
    names = sorted(sums)
    prototypes = np.stack([sums[g] / np.linalg.norm(sums[g]) for g in names])
    for r in identify(spark, docs).collect():
        x = brute_profile(rows[r["doc_id"]][1], 512)
        cosine = prototypes @ (x / np.linalg.norm(x))
        assert r["lang_pred"] == names[int(cosine.argmax())] and abs(r["score"] - cosine.max()) < 1e-4


# -- quality and toxicity --------------------------------------------------------------
@pytest.mark.parametrize(("score", "label", "least"), [(score_quality, "quality", 0.97), (score_toxicity, "toxic", 0.85)])
def test_held_out_scores(spark, score, label, least):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    got = score(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out").select("score", label, "predicted").collect()
    assert auc([r[0] for r in rows], [r[1] for r in rows]) > least
    assert all(0 <= r[0] <= 1 for r in rows)


@pytest.mark.parametrize(("score", "label", "cut"), [(score_quality, "quality", 0.3), (score_toxicity, "toxic", 0.5)])
def test_scores_of_odd_rows(spark, score, label, cut):
    rng = random.Random(9)
    prose = lambda: " ".join(rng.choice("oak elm ash fir bay yew fig may".split()) + rng.choice("aeiou") for _ in range(6))
    docs = table(spark, [*ODD, *((100 + i, f"{prose()} {'lovely' if i % 2 else 'rubbish'} {prose()}", "en") for i in range(200))])
    labels = spark.createDataFrame([(100 + i, i % 2 if label == "quality" else 1 - i % 2) for i in range(200)] + [(1, 1), (2, None), (3, 7), (101, 1)], f"doc_id long, {label} int")
    got = score(docs, labels).collect()
    assert len(got) == 206
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) and r["held_out"] == is_held_out(r["doc_id"])
    by = {r["doc_id"]: r["score"] for r in got if (r["doc_id"] or 0) >= 100}
    order = [by[i] for i in sorted(by)]
    sign = 1 if label == "quality" else -1
    assert sign * (np.mean(order[1::2]) - np.mean(order[::2])) > 0.2
    none = labels.limit(0)
    assert len({r["score"] for r in score(docs, none).collect()}) == 1
    assert score(docs.limit(0), labels).count() == 0


def test_folded_weights_equal_the_softmax_of_mean_vectors():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab cd\n"), 80)) for _ in range(12)]
    means = quality.document_means(texts)
    model = quality.train(means, rng.integers(0, 2, 12), epochs=1)
    weights, constant = model.folded()
    for bucket, share in means:
        z = model.output @ (share @ model.vectors[bucket]) + model.bias
        assert np.isclose(1 / (1 + np.exp(z[0] - z[1])), 1 / (1 + np.exp(-(share @ weights[bucket] + constant))), atol=1e-5)


def test_features_are_words_pairs_and_character_ngrams_of_words():
    text, other = "The cäT sat\tthe", "x"
    raw = np.frombuffer((text + other).encode(), dtype=np.uint8)
    parts = list(quality._features(raw, np.array([0, len(text.encode()), len(raw)])))
    own = [b[o == 0].tolist() for b, o in parts]
    padded = [f" {w} " for w in text.lower().split()]
    grams = lambda n: [w[k : k + n] for w in padded for k in range(len(w) - n + 1)]
    assert [len(x) for x in own[:2]] == [4, 3] and own[0][0] == own[0][3]
    for n in (3, 4):
        got = [b for bucket, o in parts[2:] for b in bucket[o == 0].tolist()]
        want = grams(n)
        mine = got[: len(grams(3))] if n == 3 else got[len(grams(3)) :]
        assert len(mine) == len(want)
        names = {}
        assert all(names.setdefault(b, g) == g for b, g in zip(mine, want)) and len(names) == len(set(want))


def brute_windows(model, text):
    """Savings of the windows of a text, each compressed by itself."""
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    out = []
    for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP) if words else ():
        window = toxicity.CARRIER + b"".join(b" " + w for w in words[at : at + toxicity.WINDOW]) + b" " + toxicity.CARRIER
        sizes = []
        for content in (model.ordinary, model.toxic + model.ordinary):
            plain = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
            held = zstandard.ZstdCompressionDict(content + toxicity.CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=plain)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=held, compression_params=plain).compress(window)))
        out.append(sizes[0] - sizes[1])
    return out


def test_window_savings_and_features_equal_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "TOGETHER", 3)
    rng = random.Random(3)
    bits = "house garden window rotten scum moron Über 42 the and river stone".split()
    texts = [" ".join(rng.choice(bits) for _ in range(n)) for n in (0, 1, 7, 8, 9, 14, 15, 60)] + [None, "?!", "x" * 5000]
    model = toxicity.DistanceModel(b" house garden window the and river stone", b" rotten scum moron")
    got = np.concatenate([x for _, x in model.features(pa.array(texts, pa.large_string()))])
    for x, t in zip(got, texts):
        d = sorted(brute_windows(model, t), reverse=True)
        n = len(d)
        want = [d[0], sum(d[:3]) / 3, sum(d) / n, sum(v > 4 for v in d) / n, sum(v > 6 for v in d) / n, math.log1p(n)] if d else [0] * 6
        assert np.allclose(x, want)
    assert got[-4:, 0].tolist()[1:3] == [0, 0] and got[7, 0] > 0


def test_whole_texts_train_the_dictionaries():
    rng = random.Random(5)
    filler = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9))) for _ in range(400)]
    prose = lambda extra: " ".join(rng.choice(filler) if rng.random() > 0.1 or not extra else rng.choice(extra) for _ in range(120)).encode()
    plain, bad = [b" " + prose([]) for _ in range(300)], [b" " + prose(["vilemonger", "grubsnatch"]) for _ in range(300)]
    model = toxicity.DistanceModel(toxicity._dictionary(plain, 20_000, 4), toxicity._dictionary(bad, 4000, 40))
    assert b"vilemonger" in model.toxic and b"vilemonger" not in model.ordinary
    clean, hit = (toxicity.CARRIER + b" " + x + b" " + toxicity.CARRIER for x in (" ".join(filler[:8]).encode(), (" ".join(filler[:7]) + " vilemonger").encode()))
    assert model.savings([hit])[0] > model.savings([clean])[0]


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("y"))
    a = {r["id"] for r in bounded_sample(rows, "id", "y", 500).collect()}
    b = bounded_sample(rows.repartition(7), "id", "y", 500)
    counts = {r["y"]: r["count"] for r in b.groupBy("y").count().collect()}
    assert a == {r["id"] for r in b.collect()} and counts["rare"] == 200 and 400 < counts["common"] < 600


# -- secrets -----------------------------------------------------------------------------
def brute_base(text):
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", "password", "=", ": ", " = \"", "'", "abc", "x9/+-._=", "deadbeef" * 4, "0123456789abcdef" * 2, "AKIA", "ABCD1234EFGH", " ", "\n", "é", "😀", "ſecret", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", "a" * 500_000 + " token=abcdefgh12"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in find_secrets(df).collect()}
    for i, t in enumerate(texts):
        want, r = brute_base(t or ""), got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r["spans"].split(",")) | {""} and [s for s in r["spans"].split(",") if s and not s.startswith("random")] == want
    assert find_secrets(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def ordinary():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks()
    counts = np.zeros(729, dtype=np.int64)
    for part in secret_scan._transitions(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        counts[part.column(0).to_numpy()] += part.column(1).to_numpy()
    plain = re.sub("[^a-z]", " ", " ".join(t or "" for t in texts.to_pylist()).lower())
    assert counts.reshape(27, 27)[20, 8] == plain.count("th")  # t then h
    return secret_scan.Ordinary(counts.reshape(27, 27), simulated=800)


def brute_statistic(token, encoding):
    alphabet = secret_scan.ALPHABETS[encoding]
    n, size = len(token), len(alphabet)
    chi = sum((token.count(c) - n / size) ** 2 / (n / size) for c in alphabet)
    uniform = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    kind = lambda c: 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3
    kinds = [kind(c) for c in token] if len({kind(c) for c in alphabet}) > 1 else [2 * alphabet.index(c) >= size for c in token]
    each = [kinds.count(k) for k in set(kinds)]
    two, three = sum(k**2 for k in each), sum(k**3 for k in each)
    spread = math.sqrt(max(two * (two + n * (n + 1)) - 2 * n * three - n**3, 0) / (n * n * (n - 1)))
    runs = 1 + sum(a != b for a, b in zip(kinds, kinds[1:]))
    alternate = (runs - (n * (n + 1) - two) / n) / spread if spread > 1e-9 else -math.sqrt(n)
    v = [alphabet.index(c) - sum(alphabet.index(x) for x in token) / n for c in token]
    serial = sum(a * b for a, b in zip(v, v[1:])) / sum(x * x for x in v) * math.sqrt(n) if any(abs(x) > 1e-12 for x in v) else math.sqrt(n)
    return uniform**2 + alternate**2 + serial**2


def test_battery_equals_brute_force():
    rng = random.Random(2)
    for encoding, alphabet in secret_scan.ALPHABETS.items():
        for n in (20, 33, 100):
            tokens = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(5)] + [alphabet[0] * n, (alphabet * n)[:n]]
            assert np.allclose(secret_scan.statistic(tokens, encoding), [brute_statistic(t, encoding) for t in tokens])


@pytest.mark.parametrize(("alphabet", "length", "least"), [(string.ascii_letters + string.digits, 40, 0.8), (secret_scan.ALPHABETS["base64"], 40, 0.8), (string.ascii_lowercase, 64, 0.8), (string.ascii_letters, 64, 0.8), (secret_scan.ALPHABETS["base32"], 40, 0.8), ("0123456789ABCDEF", 64, 0.8)])
def test_random_strings_are_found(ordinary, alphabet, length, least):
    rng = random.Random(1)
    make = lambda: "".join(rng.choice(alphabet) for _ in range(length))
    assert sum(bool(secret_scan.random_spans(f"see {make()} there", [], ordinary)) for _ in range(100)) > 100 * least


def test_ordinary_tokens_are_not_reported(ordinary):
    fixed = ["file_name_with_many_parts_2024_01", "abcdefghijklmnopqrstuvwxyz0123456789", "a1" * 20, "users/home/documents/report2024final12", "version2023released2024update", "1234567890" * 4, "TheQuickBrownFoxJumpsOverTheLazyDog"]
    assert not any(secret_scan.random_spans(t, [], ordinary) for t in fixed)
    words = [w for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:300] if t for w in t.split() if w.isalpha() and w.isascii()]
    rng, reported, tried = random.Random(4), 0, 0
    for _ in range(1500):
        at, style = rng.randrange(len(words) - 20), rng.choice(["", "_", "-", "/"])
        token = style.join(w.capitalize() if rng.random() < 0.5 else w for w in words[at : at + rng.randint(5, 15)])
        tried += len(token) >= 20
        reported += bool(secret_scan.random_spans(token, [], ordinary))
    assert tried > 1000 and reported <= 0.01 * tried


def test_corpus_has_no_random_prose(spark):
    got = find_secrets(documents(spark, "/root/testdata/sf0.01"))
    assert got.filter("n_assign + n_hex + n_access > 0").count() > 0 and got.filter("spans like '%random%'").count() == 0


# -- shards ------------------------------------------------------------------------------
def test_store_round_trip_versions_and_conflicts(spark, tmp_path):
    docs = documents(spark, "/root/testdata/sf0.001")
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=100_000, small_bytes=20_000, fanout=3)
    assert store.read() is None and store.compact() == 0
    for k in range(5):
        store.append(docs.filter(F.col("doc_id") % 5 == k))
    assert store.versions() == [1, 2, 3, 4, 5]
    version = store.compact()
    runs = store.runs()
    assert len(runs) == 1 and sum(r.rows for r in runs) == docs.count()
    whole = store.read().select(*docs.columns)
    assert whole.exceptAll(docs).count() == 0 and docs.exceptAll(whole).count() == 0
    assert store.read(1).count() == docs.filter("doc_id % 5 = 0").count()
    sizes = [r[0] for r in store.read().groupBy("shard_no").agg(F.sum(F.octet_length("text"))).select("sum(octet_length(text))").collect()]
    assert len(sizes) == runs[0].shards and max(sizes) < 4 * 100_000
    with pytest.raises(Conflict):
        store.commit(runs, version - 1)
    with pytest.raises(ValueError):
        store.runs(99)
    store.vacuum()  # everything is younger than the grace period
    assert len(store.versions()) == version
    store.vacuum(grace_seconds=0)
    assert store.versions() == [version] and store.read().count() == docs.count()


def test_shard_table_and_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, None, 6), (None, "é", 7), (3, "x" * 300_000, 8)], "doc_id long, text string, run long")
    got = shard_table(spark, rows, f"file://{tmp_path}/a", target_bytes=100_000, small_bytes=1000).collect()
    assert sorted((r["n_bytes"] for r in got)) == [0, 1, 1, 2, 300_000]
    # A tier is a size: the long row's run is of another one than the small rows' runs.
    tier = ShardStore(spark, f"file://{tmp_path}/a", target_bytes=100_000, small_bytes=1000).tier_of(300_000)
    assert {(r["n_bytes"] == 300_000, r["shard_tier"]) for r in got} <= {(True, tier), (False, tier), (False, 0)} and tier == 5
    assert shard_table(spark, rows.limit(0), f"file://{tmp_path}/b").count() == 0
    plan = shard_table(spark, rows, f"file://{tmp_path}/c")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_tiers_follow_size(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=100_000, small_bytes=1000, fanout=4)
    make = lambda *sizes: [Run(f"r{i}", 1, 1, n) for i, n in enumerate(sizes)]
    assert [[r.bytes for r in t] for t in store.tiers(make(5_000_000, 3, 900, 500, 7000, 8000, 9000))] == [[3, 500, 900], [7000, 8000, 9000], [5_000_000]]
    assert [store.tier_of(n) for n in (0, 1000, 1001, 4000, 4001, 16_001)] == [0, 0, 1, 2, 2, 3]
    rows = lambda n, at, size: spark.range(at, at + n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), size).alias("text"))
    store.append(rows(50, 0, 2000))
    large = store.runs()[0]
    for k in range(4):
        store.append(rows(2, 1000 + k, 2))
    store.compact()
    after = store.runs()
    assert large in after and len(after) == 2  # four small runs are one; the large one is as it was
    assert store.read().count() == 58


def test_tiers_do_not_chain_and_merges_are_bounded(spark, tmp_path, monkeypatch):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=16000, small_bytes=16, fanout=4)
    growing = [Run(f"run-{i}", 1, 1, 16 * i) for i in range(1, 41)]
    tiers = store.tiers(growing)
    assert sorted(r.bytes for t in tiers for r in t) == [r.bytes for r in growing]
    assert all(t[-1].bytes <= 2 * t[0].bytes for t in tiers) and all(a[-1].bytes < b[0].bytes for a, b in zip(tiers, tiers[1:]))
    # A merge of a tier is at least two and a half times its largest run.
    assert all(sum(r.bytes for r in t) >= 2.5 * t[-1].bytes for t in tiers if len(t) >= store.fanout)
    monkeypatch.setattr("loreweave.llm.sharding.MERGE_RUNS", 4)
    read, plain = [], ShardStore._read
    monkeypatch.setattr(ShardStore, "_read", lambda self, runs: read.append(len(runs)) or plain(self, runs))
    # Nine runs of two schemas in one append: one scan for each schema, at most four runs a merge, no row lost.
    store.append(spark.range(80).select(F.col("id").alias("doc_id"), F.lit("x" * 40).alias("text")), F.col("doc_id") % 8)
    store.append(spark.range(80, 90).select(F.col("id").alias("doc_id"), F.lit("x" * 40).alias("text"), F.lit(1).alias("more")))
    store.compact()
    assert read and max(read) <= 4
    got = store.read()
    assert sorted((r["doc_id"], r["more"]) for r in got.collect()) == [(i, 1 if i >= 80 else None) for i in range(90)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2


def test_writers_that_lose_a_race_try_again(spark, tmp_path, monkeypatch):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=100_000, small_bytes=1000)
    other = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=100_000, small_bytes=1000)
    row = lambda i: spark.createDataFrame([(i, "t")], "doc_id long, text string")
    plain, raced = ShardStore.commit, []

    def commit(self, runs, after):
        if self is store and not raced:
            raced.append(other.append(row(2)))
        return plain(self, runs, after)

    monkeypatch.setattr(ShardStore, "commit", commit)
    assert store.append(row(1)) == 2
    assert sorted(r["doc_id"] for r in store.read().collect()) == [1, 2]
    with pytest.raises(ValueError):
        store.append(row(3).withColumn("shard_no", F.lit(5)))


def test_rows_of_a_hot_id_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 10)
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).cast("long").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    got = shard_table(spark, rows, f"file://{tmp_path}/s", target_bytes=3000, small_bytes=1000).collect()
    assert len(got) == 300 and len({r["shard_no"] for r in got if r["doc_id"] == 7}) > 3 and len({r["shard_no"] for r in got if r["doc_id"] is None}) > 3
