"""Line dedup against a slow version, the registered SQL, and the whole pipeline."""

import collections
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from logpipe.llm import linededup, queries
from logpipe.llm.queries import tokenizer

SF_DIR = "/root/testdata/sf0.001"


def mask(line):
    return re.sub(r"[^ ]*[0-9][^ ]*", "<*>", re.sub(r"[ \t\r\x0b\f]+", " ", line).strip(" "))


def slow_line_dedup(rows, depth, least, share):
    lines = [(r, i, m) for r, (i, t) in enumerate(rows) if t is not None for m in {mask(x) for x in t.split("\n")} - {""}]
    leaves = collections.defaultdict(list)
    for r, i, m in lines:
        tokens = m.split(" ")
        leaves[len(tokens), tuple(tokens[:depth])].append((r, i, m, tokens))
    keeper = {}
    for members in leaves.values():
        support = collections.defaultdict(set)
        for r, _, _, tokens in members:
            for place in enumerate(tokens):
                support[place].add(r)
        groups = collections.defaultdict(list)
        for r, i, m, tokens in members:
            fixed = tuple((p, t) for p, t in enumerate(tokens) if t != "<*>" and len(support[p, t]) >= least)
            if len(fixed) >= share * len(tokens):
                groups[fixed].append((r, i, m))
        for own in groups.values():
            if len({r for r, _, _ in own}) >= least:
                ids = [i for _, i, _ in own if i is not None]
                for _, _, m in own:
                    keeper[m] = min(ids) if ids else None
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept = [x for x in t.split("\n") if mask(x) not in keeper or keeper[mask(x)] == i]
        n = sum(mask(x) != "" for x in t.split("\n"))
        out.append((i, "\n".join(kept), n, len(t.split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("small", [200_000, 0])
def test_line_dedup(docs_of, words, monkeypatch, small):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", small)
    rng = random.Random(12)
    rows = []
    for i in range(40):
        lines = [" ".join(words(rng.randint(1, 12), 100 * i + j)) for j in range(rng.randint(0, 6))]
        lines.insert(rng.randint(0, len(lines)), f"All rights reserved {1990 + i}.")
        if i % 2:
            lines.append(f"  posted by user {rng.choice(words(40, 3))} on\tpage {i} of 9")
        if i % 3:
            lines += ["", "Subscribe to our letter now", "Subscribe to our letter now"]
        rows.append((i, "\n".join(lines)))
    variants = ["we met at the old red door of " + w for w in words(60, 5)]
    rows += [(200, "\n".join(variants)), (201, "\n".join(variants[:30]))]  # many variants, but in two documents
    rows += [(210 + i, f"sold by {words(1, 900 + i)[0]} in the town hall of ours") for i in range(8)]
    rows += [(220, "\n".join(f"kept by {w} in the back room of ours" for w in words(9, 6)))] * 4  # repeated rows are documents
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "All rights reserved 7."), (103, rows[1][1]), (1, rows[1][1]),
             (104, " ".join(words(30_000, 1)) + "\nSubscribe to our letter now")]
    df = docs_of(rows)
    got = linededup.line_dedup(df, min_docs=5)
    assert got.columns == [*df.columns, "_n_lines", "_n_dropped"]
    got = [(r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"]) for r in got.collect()]
    want = slow_line_dedup(rows, linededup.DEPTH, 5, linededup.SIMILARITY)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 60
    assert linededup.line_dedup(df.where("false")).count() == 0
    clash = df.withColumn("_n_lines", F.lit("x")).withColumn("_n_dropped", F.lit("y"))
    same = linededup.line_dedup(clash, min_docs=5)
    assert same.columns == [*df.columns, "_n_lines", "_n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"]) for r in same.collect()), key=str) == sorted(want, key=str)
    alone = docs_of([(None, "same old line")] * 12)
    assert {r["text"] for r in linededup.line_dedup(alone).collect()} == {"same old line"}


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_sql(spark, name):
    if not os.path.exists(f"{SF_DIR}/documents.parquet"):
        pytest.skip("test data not present")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    res = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    df = entry.queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(cols)
    assert bag(df.columns, map(tuple, df.collect())) == bag(cols, res.fetchall())


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_pipeline_over_planted_documents(spark, words, tmp_path):
    """Each stage's decisions on documents whose fate is known."""
    from test_simhash import slow_fingerprint

    passage = words(60, 1)
    rows = []
    for i in range(30):  # clean, all different, with one license line in common
        rows.append((i, " ".join(words(80, 50 + i)) + "\nAll rights reserved 2024.", "xx", "s"))
    rows += [(100, None, "xx", "s"), (101, "123 ...", "xx", "s"),                        # no language
             (110, " ".join(words(90, 7)), "xx", "s"), (111, " ".join(words(90, 7)), "xx", "s"),  # copies
             (120, " ".join(words(40, 8) + passage + words(40, 9)), "xx", "s")]           # benchmark passage
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            seen.append(ids(docs))
    clean = list(range(30))
    assert seen[0] == [*clean, 110, 111, 120] == seen[1]
    assert seen[2] == [*clean, 110, 120] and seen[3] == [*clean, 110]
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert texts[0]["text"].endswith("reserved 2024.") and "reserved" not in texts[5]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert len({slow_fingerprint(r["text"]) for r in texts.values()}) == 31
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in pieces}) == seen[3] and all(r["offset"] + r["length"] <= 4096 for r in pieces)
    from logpipe.llm import vocabulary
    library = vocabulary.library(tokenizer("word_bpe_49k.json"))
    for r in pieces:
        assert r["length"] == len(library.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids) + 1


def test_pipeline_with_clashing_names_and_without_rows(spark, words, tmp_path):
    """Extra columns keep their names and values in every stage; an empty table passes through all of them."""
    clash = ["_n_lines", "_n_dropped", "__text_hash", "__kept_id", "__kept_hash", "n_lines", "kept", "going", "row", "hash",
             "doc", "lang_pred", "score", "_held_out", "held_out", "contaminated", "n_words", "root", "t", "x", "m", "id", "key"]
    rows = [(i, " ".join(words(70, i % 20)) + "\nAll rights reserved 2024.", "xx", "s", 1) for i in range(24)]
    rows += [(None, None, None, None, None), (3, rows[3][1], "xx", "s", 1), (50, "", "xx", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in clash})
    spark.createDataFrame([(1, "no such words at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, table in (("some", df), ("none", df.where("false"))):
        docs = table
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.schema.names == df.schema.names, stage_name
            docs.write.parquet(f"{tmp_path}/{name}-{stage_name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage_name}")
        out = docs.collect()
        assert sorted(r["doc_id"] for r in out) == (list(range(21)) if name == "some" else [])  # 0 keeps the line, 20 does not
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out for c in clash)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert len(pieces.collect()) == len(out)
