"""The pipeline against plain versions of its stages on the smallest table."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def lines_kept(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first, docs_of = {}, {}
    for d, t in rows.items():
        for k in {key(x) for x in t.split("\n")}:
            first[k] = min(d, first.get(k, d))
            docs_of.setdefault(k, set()).add(d)
    out = {}
    for d, t in rows.items():
        kept = [x for x in t.split("\n") if len(key(x)) < 10 or len(docs_of[key(x)]) < 2 or first[key(x)] == d]
        if "\n".join(kept).strip(" ") or len(kept) == len(t.split("\n")):
            out[d] = "\n".join(kept)
    return out


def test_stages(spark, sf_dir):
    from tests.llm.test_jaccard import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").persist()
    columns = docs.columns
    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    clean = clean.persist()
    deduped = stages["line dedup"](spark, clean, sf_dir)
    assert deduped.columns == columns
    assert text_of(deduped) == lines_kept(text_of(clean))
    deduped = deduped.persist()
    single = stages["n-gram Jaccard join"](spark, deduped, sf_dir)
    want = {c for _, c, _ in brute(sorted(text_of(deduped).items()))}
    assert single.columns == columns and set(text_of(single)) == want
    single = single.persist()
    decontaminated = stages["benchmark decontamination"](spark, single, sf_dir)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {d for d, t in text_of(single).items() if any(i in t for i in items)}
    assert not gone & set(text_of(decontaminated)) and decontaminated.columns == columns
    last = stages["SentencePiece encoding"](spark, decontaminated, sf_dir).collect()
    assert {r["doc_id"] for r in last} == set(text_of(decontaminated)) and all(r["decoded"] for r in last)
    assert {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r["doc_id"], r["ids_sha256"]) for r in last}


def test_edge_cases_of_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, a clashing column and an empty table."""
    toxic = [(i, f"vile rotten scum number {i}" if i % 2 else f"a quiet walk by the river {i}") for i in range(60)]
    spark.createDataFrame([(i, 1, i % 2) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long_ = " ".join(f"w{k}" for k in range(40_000))
    rows = [(i, t, None, None, 1, 0.5) for i, t in toxic] + [(100, None, "en", "s", None, 0.1), (101, "", None, None, 0, None), (102, long_, "en", "s", 5, 0.2), (102, long_, "en", "s", 5, 0.2), (None, "no id at all", None, None, 3, 0.3), (None, None, None, None, None, None), (103, leak, "en", "s", 1, 0.4), (104, long_ + " x", "en", "s", 5, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).persist()
        assert left.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    out = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert {100, 101, 102} <= set(ids) and ids.count(102) == 1 and ids.count(None) == 2 and not {103, 104} & set(ids)
    assert all(r["decoded"] for r in out) and sorted(map(repr, ids)) == sorted(repr(r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
