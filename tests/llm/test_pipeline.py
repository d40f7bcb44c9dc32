"""The pipeline against a slow version of its stages."""

import hashlib
import re
from collections import Counter

import sentencepiece
from test_operators import components_by_hand, lowered, slow_fingerprint

import corpus_pipeline
from cohortlake.llm import mixing, toxicity
from cohortlake.llm.queries import oracle_sql, queries, tokenizer_file


def test_stages_and_result(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity_of(docs, labels).filter("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in rejected]
    assert {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, data).collect()} == {r.doc_id for r in rows}
    best = {}
    for r in rows:
        key = lowered(r.text or "")
        best[key] = max(best.get(key, r.doc_id), r.doc_id)
    rows = [r for r in rows if best[lowered(r.text or "")] == r.doc_id]
    roots = components_by_hand([(r.doc_id, slow_fingerprint(r.text or "")) for r in rows])
    rows = [r for r, c in zip(rows, roots, strict=True) if r.doc_id == c]
    kept = spark.createDataFrame(rows, docs.schema)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(kept).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    expected = Counter()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        while taken[r.doc_id] > 0:
            text = r.text if taken[r.doc_id] >= len(words) else " ".join(words[: taken[r.doc_id]])
            ids = library.encode(text)
            expected[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
            taken[r.doc_id] -= len(words)
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, data).collect())
    assert found == expected


def test_stage_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
        assert stage(spark, docs.limit(0), data).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), data).count() == 0


def test_registered_queries():
    names = list(queries())
    assert [int(re.match(r"op(\d+)_", x)[1]) for x in names if x.startswith("op")] == list(range(1, 11)) and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
