"""The pipeline against a plain version of each stage, in order."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, jaccard_join, mixing, registry, secret_scan, stages
from tests.llm.test_operators import true_links

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = {r.doc_id: r for r in docs.collect()}
    known = stages.language_id(spark, docs, SF)
    ids = [r.doc_id for r in known.select("doc_id").collect()]
    assert len(ids) >= 0.99 * len(plain)
    _, links = true_links([(i, plain[i].text) for i in ids])
    left, seen = set(), set()
    for i in sorted(ids):  # the smallest id of each component
        if i not in seen:
            left.add(i)
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    todo += links[j]
    one = jaccard_join.one_of_each(known)
    assert {r.doc_id for r in one.select("doc_id").collect()} == left
    clean = secret_scan.redact(one)
    crf = secret_scan.field()
    for r in clean.collect():
        text, out, at = plain[r.doc_id].text, "", 0
        for _, a, b in secret_scan.all_spans(text, crf):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + text[at:]
    mixed = mixing.mix(clean)
    times = {r.doc_id: r.copies for r in mixing.with_copies(clean).select("doc_id", "copies").collect()}
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({i: n for i, n in times.items() if n})
    coder = bpe.WordBpe(open(registry.tokenizer_path(), encoding="utf-8").read())
    texts = {r.doc_id: r.text for r in clean.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in times.items() if n})
    assert all(r.n_tokens == len(coder.encode(texts[r.doc_id])) for r in got)


def test_stage_names_and_columns(spark):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.filter(F.col("doc_id") < 40), SF).columns == docs.columns
