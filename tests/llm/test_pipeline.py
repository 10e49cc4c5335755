"""The pipeline's stages against brute force on a small corpus, and the registered queries."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import mixing, quality, simhash
from attestor.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(30) for _ in range(10)]
    rows, labels, leaked, bad = [], [], set(), set()
    for i in range(400):
        t = say(rng.randint(40, 150)).capitalize() + "."
        if i % 10 == 3:
            t = " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in t.split())
            bad.add(i)
        elif i % 40 == 7:
            t += "\n" + items[i // 40]
            leaked.add(i)
        elif i % 25 == 4 and rows:
            t = next(r[1] for r in rows if r[0] == i - 4)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        if i % 2:
            labels.append((i, int(i not in bad), 0))
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, {r[0]: r[1] for r in rows}, leaked, bad


def test_stages_and_run(spark, tables, tmp_path):
    root, texts, leaked, bad = tables
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, root)
        if name != "sharding":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").distinct().collect()}
    assert len(ids("quality") & bad) <= 2 and len(set(texts) - bad - ids("quality")) <= 8
    fp = {i: simhash.fingerprint(texts[i].encode()) for i in ids("quality")}
    first = {}
    for i in sorted(fp):
        first.setdefault(next((j for j in first if bin(fp[i] ^ fp[j]).count("1") <= 3), i), i)
    assert ids("near_duplicates") == set(first)
    assert ids("decontamination") == ids("near_duplicates") - leaked
    plan = mixing.mix_plan(seen["decontamination"]).agg(F.sum("taken")).first()[0]
    assert seen["mixing"].agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == plan
    assert seen["sharding"].count() == seen["mixing"].count()
    one = sorted((r.doc_id, r.text, r.shard) for r in corpus_pipeline.run(spark, root).collect())
    assert one == sorted((r.doc_id, r.text, r.shard) for r in seen["sharding"].collect())


def test_empty_pipeline(spark, tables, tmp_path):
    root = tables[0]
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
    assert docs.count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"] and quality.THRESHOLD == 0.3
