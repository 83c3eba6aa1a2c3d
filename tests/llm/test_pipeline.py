"""The pipeline on planted documents: noise goes, copies leave one, everything else is packed whole."""

import random

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(80)]

    def clean():
        w = [rng.choice(words)]
        for _ in range(150):
            w.append(words[(words.index(w[-1]) * 7 + rng.randint(0, 5)) % 80])
        return " ".join(w)

    shared = "this line stands in many documents, so that all but one lose it"
    docs = {i: clean() for i in range(120)}
    for i in range(10, 18):
        docs[i] += "\n" + shared
    docs[300], docs[301] = docs[3], docs[4] + " tail"
    noise = {400 + i: " ".join("z%d" % rng.randint(0, 10**6) for _ in range(100)) for i in range(8)}
    short = {500: "w1 w2 w3"}
    everything = docs | noise | short | {600: None}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in everything.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = {r["doc_id"] for r in now.collect()}
        if k < 4:
            assert now.columns == list(corpus_pipeline.COLUMNS)
    assert seen["quality classifier"].isdisjoint(noise) and set(docs) <= seen["quality classifier"]
    assert seen["quality rules"] == set(docs)
    assert seen["line dedup"] == set(docs)
    assert seen["n-gram Jaccard join"] == set(docs) - {300, 301}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {i: t.replace("\n" + shared, "") if i != 17 else t for i, t in docs.items() if i < 300}
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r["doc_id"]: r["length"] for r in now.collect()} == want


ROWS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_lines int, sig long"


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, repeated and missing doc_ids, a very long text and clashing columns, each stage on all its predecessor kept."""
    rng = random.Random(2)
    text = lambda n: " ".join("w%d" % rng.randint(0, 2000) for _ in range(n))
    long, twice = text(60_000), text(90)
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, twice), (5, twice), (None, text(80)), (None, None), (6, twice), (7, text(100))]
    rows = [(i, t, None if i == 7 else "en", None, None, False, 1, 2) for i, t in rows]
    labels = spark.createDataFrame([(7, 1, None), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    awkward = spark.createDataFrame(rows, ROWS).repartition(3)
    kept = {}
    for given in (awkward, awkward.limit(0)):
        now, empty = given, given is not awkward
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{'empty' if empty else 'awkward'}{k}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            assert not empty or now.count() == 0
            if not empty:
                kept[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in now.collect())
            if k < 4:
                assert now.columns == list(corpus_pipeline.COLUMNS)
    everything = sorted((r[0] is None, r[0] or 0) for r in rows)
    assert kept["quality classifier"] == everything
    # a missing doc_id has a text without words among its rows, so that both go
    assert kept["quality rules"] == kept["line dedup"] == [(False, i) for i in (4, 5, 5, 6, 7)]
    assert kept["n-gram Jaccard join"] == [(False, i) for i in (4, 5, 5, 7)]
    assert {i for _, i in kept["best-fit packing"]} == {4, 5, 7}
