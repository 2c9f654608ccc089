"""Top-k, decontamination, language and quality against brute force and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logpipe.llm import decontaminate, langid, quality, topk
from logpipe.llm.sql import TOP_K_SQL


# ------------------------------------------------------------------ top-k
LONG = 2 ** 63 - 1


def slow_top(vectors, queries, k):
    """Every row counts; queries of one id share a list."""
    def ints(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [
            math.floor(1024 * x) for x in v]
    usable = [(i, ints(v)) for i, v in vectors if i is not None and ints(v) is not None]
    out = Counter()
    for q in sorted({i for i, _ in usable if i in queries}):
        scored = sorted((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(qv, v)))), i)
                        for me, qv in usable if me == q for i, v in usable if i != q)
        out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k]))
    return out


@pytest.mark.parametrize("tiles", [(1024, 4096, 4 << 20), (2, 7, 100)])
def test_top_k(spark, monkeypatch, tiles):
    for name, value in zip(("QUERY_TILE", "CANDIDATE_TILE", "BLOCK_BYTES"), tiles):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)]) for i in range(60)]
    vectors += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan"), 0.0, 0.0, 0.0]),
                (63, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (70, [0.5, 0.5]), (71, [])]
    vectors += [(3, vectors[3][1]), (5, vectors[5][1]), (5, [1.0, 1.0, 1.0, 1.0]), (10, vectors[10][1])] + [vectors[7]] * 20
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)) \
        .withColumn("block", F.lit(1)).withColumn("rank", F.lit(1)).repartition(3)
    ids = {i for i in range(0, 72, 5)}
    got = topk.top_k(df.where("vec_id % 5 = 0"), df, 10)
    as32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert Counter(tuple(r) for r in got.collect()) == slow_top(as32, ids, 10)
    assert topk.top_k(df.where("false"), df).count() == topk.top_k(df, df.where("false")).count() == 0
    small = topk.top_k(df.where("vec_id = 5"), df.where("vec_id < 4"))
    few = [(i, v) for i, v in as32 if i is not None and (i < 4 or i == 5)]
    assert Counter(tuple(r) for r in small.collect()) == slow_top(few, {5}, 10)


def test_top_k_of_large_components(spark):
    vectors = [(0, [4e15, 1.0]), (5, [4e15, -3.0]), (1, [4e15, 2.0]), (2, [1e18, 2.0]), (3, [2.0, 1e300]), (4, [0.002, 3.0]),
               (6, [0.001, -7.0]), (7, [1.0, 2.0]), (10, [0.25, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in topk.top_k(df.where("vec_id % 5 = 0"), df, 5).collect()) == slow_top(vectors, {0, 5, 10}, 5)


def test_top_k_equals_its_sql_on_repeated_rows(spark):
    rng = random.Random(9)
    vectors = [(rng.randint(0, 250), [rng.choice([0.0, 0.5, rng.random()]) for _ in range(6)]) for _ in range(200)]
    vectors += rng.sample(vectors, 80) + [(0, vectors[1][1]), (100, vectors[0][1]), (200, [1.0] * 6), (200, [1.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    embeddings = df.toArrow()  # noqa: F841  read by the SQL
    want = duckdb.sql(TOP_K_SQL).fetchall()
    got = topk.top_k(df.where("vec_id % 100 = 0"), df)
    columns = [d[0] for d in duckdb.sql(TOP_K_SQL).description]
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want) and len(want) == 30


def test_products_of_large_numbers_are_exact():
    q, c = np.array([[2.0 ** 30, 3]]), np.array([[2.0 ** 31, 1], [1, 1]])
    assert topk.product(q, c).tolist() == [[2 ** 61 + 3, 2 ** 30 + 3]]
    assert topk.product(q * 4, c * 4).tolist() == [[LONG, 2 ** 34 + 48]]


# ------------------------------------------------------------------ decontamination
def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                      "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_verdict(text, items, window):
    words, hit, found = slow_words(text), set(), set()
    for item, item_text in items:
        own = slow_words(item_text)
        if own:
            n = min(window, len(own))
            for i in range(len(own) - n + 1):
                for j in range(len(words) - n + 1):
                    if words[j:j + n] == own[i:i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return (len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(words))


@pytest.mark.parametrize("block_bytes,search_bytes", [(8 << 20, 4 << 20), (150, 60)])
def test_contamination(spark, docs_of, words, monkeypatch, block_bytes, search_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontaminate, "SEARCH_BYTES", search_bytes)
    rng = random.Random(6)
    items = [(i, " ".join(words(rng.randint(1, 30), 500 + i))) for i in range(12)]
    items += [(20, None), (21, "?!"), (22, "Zwölf"), (22, "a1 b2"), (None, "nobody's item here"), (23, "x"), (24, "x")]
    texts = ["", None, "!!", "x", "x x X\tx", "Zwölf zwölf, ZWöLF", "a1-b2", "nobody S item HERE too", "axb ab"]
    for i in range(30):
        head, tail = words(rng.randint(0, 60), i), words(rng.randint(0, 60), 70 + i)
        item = items[rng.randrange(12)][1].split(" ")
        cut = rng.randrange(len(item))
        texts.append(", ".join(head + item[cut // 2:] + tail).upper() if i % 3 else " ".join(head + tail))
    texts.append(" ".join(words(4000, 1) + items[0][1].split(" ")))
    df = docs_of([*enumerate(texts), (None, "x"), (3, "x")])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit(0)).withColumn("i", F.lit(0))
    got = decontaminate.contamination(df, bench, carry=["doc_id"]).select("doc.doc_id", *[
        "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]).collect()
    want = [(i, *slow_verdict(t, items, 13)) for i, t in [*enumerate(texts), (None, "x"), (3, "x")]]
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not w[-1] for w in want)
    none = decontaminate.contamination(df, bench.where("false")).agg(F.sum("n_hit")).first()[0]
    assert none == 0 and decontaminate.contamination(df.where("false"), bench).count() == 0


# ------------------------------------------------------------------ language
def test_language(spark):
    rng = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "ter", "bro"], "cc": ["éa", "çon", "eux"]}
    rows = []
    for i in range(240):
        lang = sorted(syllables)[i % 3]
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 30)))
        rows.append((i, text, lang if i % 5 else None, lang))
    rows += [(300, None, "aa", None), (301, "123 !?", "aa", None), (302, "", None, None), (None, "ka lo", "bb", "aa"),
             (303, "KA lo " * 30_000, None, "aa"), (1, rows[1][1], rows[1][2], rows[1][3])]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string") \
        .withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("t", F.lit("clash"))
    got = langid.identify_with_own_labels(df, carry=["doc_id"])
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r[0]: r[3] for r in rows}
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        if truth[r["doc_id"]] is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == want
    kept = langid.drop_unidentified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.identify_with_own_labels(df.where("false")).count() == 0
    none = langid.identify_with_own_labels(df.withColumn("lang", F.lit(None).cast("string")), carry=["doc_id"])
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, "ka lo", "bb" if zlib.crc32(str(i).encode()) % 4 == 2 else "aa") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify_with_own_labels(df).collect()} == {"aa"}


def test_word_scores_fall_back_to_shorter_grams():
    m = langid.Model([("aa", "kalomi", 5), ("bb", "zuterbro", 5)], {"aa": 5, "bb": 5})
    for word in ("kalomi", "kalom", "xkaloy", "xalx", "xlx"):
        a, b = m.word_scores([word])[0]
        assert a > b, word
    assert m.word_scores(["qqq"])[0].tolist() == [0, 0]
    assert m.word_scores(["kalomi", "qqq", "zuter"]).shape == (3, 2)


def test_rare_languages_keep_words_and_grams(spark, monkeypatch):
    rows = [(i, " ".join(f"zu{'abcdefgh'[i % 8]}ter{'klmn'[j % 4]}" for j in range(40)), "aa") for i in range(300)]
    rows += [(1000 + i, "kalomi kalo", "bb") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(df, train_docs=40, model_words=20)
    assert m.langs == ["aa", "bb"]
    assert [x for x, _ in m.predict(["kalomi", "lomika", "zuaterk", "terzu"])] == ["bb", "bb", "aa", "aa"]
    # n-grams of words that are not kept are known as well
    assert "zuh" in m.grams[3].at and len(m.words.at) > 2


def slow_language(rows, text):
    """(language, share of the likelihood) straight from the definition, without any cut."""
    words = {lang: Counter(w for _, t, x in rows if x == lang for w in langid.words_of(t)) for lang in sorted({r[2] for r in rows})}

    def logs(tables, name):
        size = len(set().union(*tables.values()))
        return [math.log((c[name] + 0.5) / (sum(c.values()) + 0.5 * size)) for c in tables.values()]

    grams = {}
    for k in range(1, 6):
        grams[k] = {lang: Counter() for lang in words}
        for lang, own in words.items():
            for w, n in own.items():
                for g in langid._grams(w, k):
                    grams[k][lang][g] += n
    total = np.zeros(len(words))
    for w in langid.words_of(text):
        if any(c[w] for c in words.values()):
            total += logs(words, w)
            continue
        for k in range(5, 0, -1):
            known = [g for g in langid._grams(w, k) if any(c[g] for c in grams[k].values())]
            if known:
                total += np.mean([logs(grams[k], g) for g in known], axis=0)
                break
    return list(words)[int(np.argmax(total))], float(1 / np.exp(total - total.max()).sum())


def test_scores_of_a_hundred_languages(spark):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        lang = f"l{i % 100:02d}"
        own = random.Random(lang)
        vocabulary = ["".join(own.choices("abcdeklmnort", k=own.randint(2, 7))) for _ in range(30)]
        rows.append((i, " ".join(rng.choices(vocabulary, k=25)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert len(model.langs) == 100
    texts = [rows[5][1], "abc dek", "karton elbarto", rows[77][1][:9], "mno " + rows[99][1][3:20], "12 qqq"]
    for text, (lang, score) in zip(texts, model.predict(texts)):
        want = slow_language(rows, text)
        assert lang == want[0] and score == pytest.approx(want[1])


def test_sampling_does_not_hang_on_the_id(spark):
    rows = [(None, f"ka{i} lo mi", "aa") for i in range(400)] + [(7, f"zu{i} ter", "bb") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(df, train_docs=100)
    read = sum(n for n in np.exp(m.words.above[m.words.first[m.words.at["lo"]]:][:1]))
    assert 20 < (read - 1) / 2 < 90  # about fifty of four hundred rows of one NULL id


# ------------------------------------------------------------------ quality
def test_quality(spark, words):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = words(rng.randint(5, 80), i)
        text = " ".join(w).capitalize() + "." if good else rng.choice([
            " ".join(x + "!!" for x in w).upper(), " ".join(w[:2] * 30), " | ".join(w), " ".join(x + "%%%" for x in w)])
        rows.append((i, text))
        labels.append((i, int(good)))
    rows += [(500, None), (501, ""), (None, "text"), (502, "a " * 100_000), (3, rows[3][1])]
    labels += [(None, 1), (501, None), (5, 7), (6, labels[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit("clash")).withColumn("y", F.lit(0)) \
        .withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality long").withColumn("x", F.lit(1)).withColumn("id", F.lit(0))
    out = quality.quality_scores(df, lab).collect()
    assert len(out) == len(rows)
    truth = dict(labels[:400])
    right = [r["predicted"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth and r["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.97
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert quality.quality_scores(df.where("false"), lab).count() == 0
    assert {r["score"] for r in quality.quality_scores(df, lab.where("false")).collect()} == {0.5}


def test_held_out_quality_labels_teach_nothing(spark, words):
    rows = [(i, " ".join(words(30, i)) if i % 2 else " ".join(words(30, i)).upper()) for i in range(120)]
    lab = [(i, i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2) for i, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.quality_scores(df, spark.createDataFrame(lab, "doc_id long, quality long")).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out)


def test_quality_threshold_covers_all_labels(spark, words):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        text = words(rng.randint(20, 80), i)
        noisy = rng.random()
        rows.append((i, " ".join(w + "%%" if rng.random() < noisy else w for w in text)))
        labels.append((i, int(noisy + rng.gauss(0, 0.2) < 0.3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality long")
    out = quality.quality_scores(df, lab, train_docs=60).collect()
    own = [r for r in out if not r["held_out"]]
    # as many are predicted good as are labelled good, whatever the sample
    assert sum(r["predicted"] for r in own) == sum(dict(labels)[r["doc_id"]] for r in own)


def test_kth_smallest(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) ** 5 for _ in range(2000)] + [0.25] * 500
    df = spark.createDataFrame([(v,) for v in values], "raw double")
    for k in (0, 1, 700, 1400, 2498, 2499):
        assert quality.kth(df, k, at_once=10) == sorted(values)[k]
