"""Near duplicates, exact duplicates, decontamination against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreweave.llm import near_dup, wordvec
from loreweave.llm.decontaminate import contamination
from loreweave.llm.exact_dedup import exact_duplicates
from loreweave.llm.near_dup import near_duplicates
from loreweave.operators import skew

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, label string, rep long, key string, component_id long"


def table(spark, rows):
    """Rows of (doc_id, text) with further columns that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7, "k", 9) for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def corpus(seed):
    """Bases, chains and groups of near copies around the threshold, a shared passage, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(400))
    passage = [word() for _ in range(55)]
    texts = ["", None, "   ", "one", "One", "two words", "a b c d e", "A B C D E", "a b c d e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([20, 60, 200, 400]))]
        texts += [" ".join(base)] * 2
        for _ in range(rng.randrange(8)):
            base = edited(rng, base, rng.choice([0, 1, 1, 2, 3, 6])) if rng.random() < 0.5 else base
            texts.append(" ".join(edited(rng, base, rng.choice([1, 1, 2, 4]))))
    texts += [" ".join([word() for _ in range(20)] + passage) for _ in range(60)]
    hot = [word() for _ in range(120)]
    texts += [" ".join(edited(rng, hot, rng.choice([0, 1, 1, 2, 3, 5, 8]))) for _ in range(150)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = near_duplicates(spark, table(spark, rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute_classes(rows)


def test_small_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE_BUCKET", 3)
    rows = corpus(3)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(spark, table(spark, rows)).collect()} == {i: c for i, (_, c, _) in brute_classes(rows).items()}


def test_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 4)
    monkeypatch.setattr(skew, "HOT_PARTS", 50)
    rows = corpus(4)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(spark, table(spark, rows)).collect()} == {i: c for i, (_, c, _) in brute_classes(rows).items()}
    copies = [(i, "same" if i % 3 else f"text {i % 7}") for i in range(120)] + [(5, "same"), (None, "same")]
    got = exact_duplicates(table(spark, copies)).collect()
    assert len(got) == len(copies)
    for r in got:
        ids = [i for i, t in copies if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max(i for i in ids if i is not None)


def test_odd_rows(spark):
    long = "w" * 3_000_000 + " " + "x y " * 300_000
    rows = [(1, long), (2, long + " z"), (3, None), (3, None), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, len(shingles(long)), 1, True), (2, len(shingles(long + " z")), 2, True), (3, 0, 3, True), (3, 0, 3, True), (None, 1, None, True), (5, 1, 5, True), (5, 1, 5, True)], key=str)
    assert near_duplicates(spark, table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(spark, table(spark, []), percent=50)


def test_words_of_1024_bytes_that_a_polynomial_confuses(spark):
    # The Thue-Morse word and its complement agree under any polynomial modulo 2 ** 64 with an odd base.
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} b c d e"), (2, f"{two} b c d e"), (3, one), (4, two)]
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(spark, table(spark, rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in contamination(spark, table(spark, rows), bench).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(wordvec, "LONG_WORD", 20)
    rng = random.Random(1)
    for _ in range(60):
        texts = ["".join(rng.choice("ab C\né9_ ") for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(1, 8))]
        for low, high, raw, offsets in wordvec.blocks(pa.array(texts), 200):
            hashes, first, end, counts = wordvec.word_hashes(raw, offsets, wordvec.ALNUM_WORDS)
            want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER)) for t in texts[low:high]]
            assert [raw.tobytes()[a:b].lower().decode() for a, b in zip(first, end)] == [w for ws in want for w in ws]
            assert counts.tolist() == [len(w) for w in want]
            names = {}
            assert all(names.setdefault(h, w) == w for h, w in zip(hashes.tolist(), (w for ws in want for w in ws)))


# -- exact duplicates ------------------------------------------------------------
@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, keep, weak):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "A", "a ", "é", "é" + "x" * 100_000])) for i in range(60)] + [(3, "a"), (None, "q")]
    options = {"hash_of": lambda t: F.length(t).cast("string")} if weak else {}
    got = exact_duplicates(table(spark, rows), keep=keep, **options).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = min if keep == "smallest" else max
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == (best(ids) if ids else None)
        assert r["kept"] == (not ids or r["doc_id"] == r["keep_id"])
    assert exact_duplicates(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(table(spark, []), keep="first")


def test_exact_dedup_runs_without_python(spark):
    plan = exact_duplicates(table(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LocalTableScan", ""))


# -- decontamination ----------------------------------------------------------------
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(docs, items, size=10):
    windows = []
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        windows += [(name, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if n else []
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    names |= {name} - {None}
        joined = ",".join(sorted(map(str, names)))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent_windows", [50_000, 0])
def test_hits_equal_brute_force(spark, sent_windows, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 2)
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and", "rare", "é", "42"]) + rng.choice(["", "", "x", "y", "z"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(40)] + [(100, None), (101, "Alpha-beta; gamma"), (None, "zzz qqq"), (3, "twice named item")]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            part = words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(part) - 9))
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[a : a + rng.choice([9, 10, 12, 30])]
        docs.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
    docs += [(500, None), (501, ""), (502, "alpha BETA gamma"), (502, "alpha BETA gamma"), (None, "zzz, qqq!"), (503, "alpha beta"), (504, "filler " * 300_000 + "alpha beta gamma")]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id long")
    got = contamination(spark, table(spark, docs), bench, sent_windows=sent_windows)
    assert all(sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_hit"] and r["spans"] == sorted(set(r["spans"])) for r in got.collect())
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()), key=str)
    assert rows == brute_hits(docs, items)


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in contamination(spark, table(spark, [(1, "a b")]), none).collect()] == [0]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(spark, table(spark, []), some).count() == 0


def test_words_made_to_share_linear_hashes_do_not_link(spark):
    """Two texts whose unseeded word hashes have the same weighted sum."""
    rows = [(1, "rs18bf38 il5pj3jo x y z"), (2, "1wukwdjr 5l`%%7(2 x y z"), (3, "1wukwdjr 5l`%%7(2 x y z")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark, table(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_pairs_of_many_rare_shingles_meet_about_once(spark, monkeypatch):
    """Documents that share most rare shingles and are no links made a row for each of them."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(edited(rng, base, 2))) for i in range(40)]
    sets = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).mapInArrow(near_dup._sets(5), "doc_id long, shingles binary")
    facts = sets.select(F.col("doc_id").alias("rep"), F.expr("octet_length(shingles) div 8").alias("n"))

    def met():
        rows = near_dup._prefixes(facts, sets, 80)
        a, b = (rows.select("key", *(F.col(c).alias(x if c == "rep" else f"{x}_{c}") for c in ("rep", "n", "at", "before"))) for x in "ab")
        return [tuple(r) for r in a.join(b, "key").filter(near_dup._first_met(80, F.col("a") < F.col("b"))).select("a", "b").collect()]

    found = met()
    monkeypatch.setattr(near_dup, "BEFORE", 0)
    every = met()
    assert set(found) == set(every) and len(every) > 3 * len(set(every)) > 0
    assert len(found) < 1.5 * len(set(found))


def test_a_group_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    """Documents of one group that are near each other and no links made a row for each two of them."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(200)]
    other = edited(rng, base, 12)
    texts = [" ".join(edited(rng, base, 5)) for _ in range(120)] + [" ".join(edited(rng, other, 2)) for _ in range(80)]
    rng.shuffle(texts)
    made, write = {}, near_dup.Stage.table

    def counted(stage, df, name):
        out = write(stage, df, name)
        made[name] = out.count() if name == "pairs" or name.endswith("-close") else 0
        return out

    monkeypatch.setattr(near_dup.Stage, "table", counted)
    monkeypatch.setattr(near_dup, "LARGE_BUCKET", 4)
    monkeypatch.setattr(near_dup, "MARKED_ROWS", 0)
    rows = list(enumerate(texts))
    got = near_duplicates(spark, table(spark, rows), percent=80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: c for i, (_, c, _) in brute_classes(rows, 80).items()}
    assert made["pairs"] and sum(made.values()) < 5 * len(rows), {k: n for k, n in made.items() if n}


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_parities_pass_every_link(spark, percent):
    rng = random.Random(percent)
    base = [rng.getrandbits(64) for _ in range(3000)]
    rows, links = [], []
    for i in range(400):
        n = rng.choice([1, 2, 9, 150, 3000])
        a, some = base[:n], rng.randrange(max(n // 6, 1) + 1)
        b = a[some:] + [rng.getrandbits(64) for _ in range(rng.randrange(some + 1))]
        a, b = (near_dup.np.array(sorted(x), dtype="uint64") for x in (a, b or a))
        both = len(set(a.tolist()) & set(b.tolist()))
        links.append(100 * both >= percent * (len(a) + len(b) - both))
        rows.append((i, len(a), *near_dup.parities(a).tolist(), len(b), *near_dup.parities(b).tolist()))
    names = ["i", *(f"{x}_{c}" for x in "ab" for c in ("m", *near_dup.PARITIES))]
    passed = {r["i"] for r in spark.createDataFrame(rows, names).filter(near_dup._few_unlike(percent)).select("i").collect()}
    assert {i for i, x in enumerate(links) if x} <= passed and sum(links) > 20
    assert len(passed) < len(rows)


def test_sets_move_only_for_pairs_that_may_be_links(spark, monkeypatch):
    """Near documents of small buckets that are no links each had their whole sets moved to be told so."""
    rng = random.Random(31)
    texts = []
    for g in range(10):
        base = [f"w{g}-{i}" for i in range(200)]
        texts += [" ".join(edited(rng, base, 5)) for _ in range(5)] + [" ".join(base)]
    made, write = {}, near_dup.Stage.table

    def counted(stage, df, name):
        out = write(stage, df, name)
        made[name] = out.count() if name in ("pairs", "small") else 0
        return out

    monkeypatch.setattr(near_dup.Stage, "table", counted)
    rows = list(enumerate(texts))
    got = near_duplicates(spark, table(spark, rows), percent=80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: c for i, (_, c, _) in brute_classes(rows, 80).items()}
    assert made["small"] and made["pairs"] < 10, {k: n for k, n in made.items() if n}


def test_many_sets_are_found_without_moving_texts(spark, monkeypatch):
    """Above the bound for broadcasts whole texts, and all sets, were dealt out by id to find some of them."""
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(near_dup, "bounded_broadcast", lambda df, *_: df)
    monkeypatch.setattr(near_dup, "LARGE_BUCKET", 4)
    plans, write = {}, near_dup.Stage.table

    def seen(stage, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(stage, df, name)

    monkeypatch.setattr(near_dup.Stage, "table", seen)
    rows = corpus(6)
    got = near_duplicates(spark, table(spark, rows).union(table(spark, [(None, "no id")])))
    assert {r["doc_id"]: r["component_id"] for r in got.filter("doc_id is not null").collect()} == {i: c for i, (_, c, _) in brute_classes(rows).items()}
    assert "Exchange" not in plans["sets"]


def test_rows_among_some_ids(spark, monkeypatch):
    """Every wanted row passes and few others."""
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 100)
    rows = spark.range(20000).select("id", F.lit(b"x").alias("shingles"))
    for n in (50, 2000):
        found = {r["id"] for r in near_dup._among(rows, "id", spark.range(n).toDF("rep"), n).collect()}
        assert found >= set(range(n)) and len(found) < n + 20000 / 10
