"""Every operator with nulls, empty and long texts, ties and repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import arc, bpe, hamming_topk, html_text, jaccard_join, language_id, mixing, quality_rules, secret_scan, stages, url_filter
from sparkloom.llm.registry import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, lang_pred string, ids string, kept string, host string, path string, rule string, verdict string, source_size long, target double, copies int, n_words long, class_id long, n_tokens string, score string"
OTHERS = ("h", "p", "r", "v", 3, 0.5, 9, 1, 2, "n", "s")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def rows():
    long_text = " ".join(WORDS[(k * 7 + k // 11) % 10] + str(k % 97) for k in range(30_000))
    texts = [None, "", "   \n\t", "one", "same text of a few words here", "same text of a few words here", long_text, "a\x00b ü ß 😀 \u2028 x", "x" * 50_000]
    out = [(k, t, "en" if k % 2 else None, None if k == 3 else f"s{k % 2}", None, 7, "s", "l", "i", "k", *OTHERS) for k, t in enumerate(texts)]
    out += [out[4], (None, "null id", *[None] * 19), (None,) * 21]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = [(5, 1, 0), (5, 1, 0), (None, 1, 0), (6, None, None)]


def each(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")

    def quality(d):
        return quality_rules.judge(d.select("doc_id", "text"), quality_rules.log_ratios(d.select("doc_id", "text"), labels))

    def language(d):
        return language_id.predict(d, language_id.train(d.select("doc_id", "lang", "text")))

    path = tokenizer_path()
    return {
        "quality": quality,
        "language": language,
        "secrets": secret_scan.scan,
        "redact": secret_scan.redact,
        "mixing": mixing.with_copies,
        "bpe": lambda d: bpe.encode(d, path),
        "digests": lambda d: bpe.digests(d, path),
        "jaccard": jaccard_join.join,
        "html": lambda d: html_text.extract(d.withColumnRenamed("text", "html")),
        "url": lambda d: url_filter.judge(d.withColumnRenamed("text", "url"), [("block", "net", "/")]),
    }


@pytest.mark.parametrize("name", ["quality", "language", "secrets", "redact", "mixing", "bpe", "digests", "jaccard", "html", "url"])
def test_each_row_is_answered_once_and_empty_tables_give_none(spark, docs, none, name):
    f = each(spark)[name]
    got = f(docs)
    assert len(set(map(str.lower, got.columns))) == len(got.columns)
    assert got.count() == docs.count()
    assert f(none).count() == 0
    assert f(none).columns == got.columns


def test_digests_and_thresholds_of_nothing(spark, docs, none):
    got = secret_scan.digests(docs)
    assert got.count() == docs.count() and secret_scan.digests(none).count() == 0
    assert [tuple(r) for r in got.filter("doc_id = 1").collect()] == [tuple(r) for r in secret_scan.digests(docs.filter("doc_id = 1")).collect()]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for d in (docs, none):
        d = d.select("doc_id", "text")
        for lab in (labels, labels.limit(0)):
            ratios = quality_rules.log_ratios(d, lab)
            assert quality_rules.judge(d, ratios, quality_rules.fitted_threshold(d, lab, ratios)).count() == d.count()


def test_vectors_with_nulls_inside(spark):
    rows = spark.createDataFrame([(0, [1.0, None, 1.0], "x"), (50, [1.0, -1.0, 1.0], "y"), (2, [None, None, None], "z")], "id long, v array<double>, query_id string")
    rows = rows.select("id", hamming_topk.sign_code(F.col("v")).alias("code"), "query_id")
    assert sorted(tuple(r) for r in hamming_topk.search(rows, rows.filter("id % 50 = 0"), k=2).collect()) == [(0, 1, 50, 0), (0, 2, 2, 2), (50, 1, 0, 0), (50, 2, 2, 2)]


def test_the_pipeline_runs_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_are_answered_alike(spark, docs):
    for name in ("quality", "language", "secrets", "digests", "jaccard"):
        got = [r.asDict() for r in each(spark)[name](docs).filter("doc_id IN (4, 5)").collect()]
        drop = {"doc_id", "lang", "source"}
        assert len({str(sorted((k, str(v)) for k, v in r.items() if k not in drop)) for r in got}) == 1, name


def test_stages_take_empty_and_odd_documents(spark, docs, none):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    for stage in (stages.language_id, stages.jaccard_join, stages.secret_scans, stages.mixing):
        got = stage(spark, docs.select(own), "")
        assert got.columns == own
        got.count()
        assert stage(spark, none.select(own), "").count() == 0
    assert stages.bpe(spark, none.select(own), "").count() == 0
    # repeated rows and copies leave one; rows without an id stay
    left = [r.doc_id for r in stages.jaccard_join(spark, docs.select(own), "").collect()]
    assert sorted(left, key=str) == sorted([0, 1, 2, 3, 4, 6, 7, 8, None, None], key=str)


def test_ids_with_several_texts_lose_only_near_copies(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [
        (1, a), (2, a + " z"),  # 2 is near 1
        (2, b),  # 2's other text is like no other
        (3, c), (3, c), (3, c + " z"),  # one class under one id
        (4, b + " z"), (4, None), (4, ""),  # near (2, b); two empty sets
        (None, a),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _node string").repartition(3)
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, (r.text or "")[:1]) for r in got.collect()), key=str)
    assert left == sorted([(1, "a"), (2, "b"), (3, "c"), (4, ""), (None, "a")], key=str)


def test_pages_without_url_or_html(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.net/x", b""), (3, "http://a.net/x y", b"p" * 100_000), (4, None, b"p" * 100_000), (None, "u", b"q")], "id long, url string, payload binary")
    got = {r.key: r for r in arc.archive_pages(pages.withColumn("payload", F.coalesce("payload", F.lit(b""))), str(tmp_path / "a")).collect()}
    assert [got[k].record_type for k in ("1", "2", "3", "4", "-")] == ["response", "revisit", "response", "revisit", "response"]
    assert got["2"].refers_to == "1" and got["4"].payload_bytes == 100_000 and got["4"].refers_to == "3"
    assert arc.archive_pages(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_vectors_that_are_null_short_or_repeated(spark):
    v = [(0, [1.0] * 64), (1, None), (2, []), (3, [1.0] * 64), (3, [1.0] * 64), (None, [1.0] * 64), (50, [-1.0] * 64), (100, [1.0] * 63 + [-1.0])]
    rows = spark.createDataFrame(v, "id long, v array<double>").select("id", hamming_topk.sign_code(F.col("v")).alias("code"))
    got = sorted(tuple(r) for r in hamming_topk.search(rows, rows.filter("id % 50 = 0"), k=2).collect())
    assert got == [(0, 1, 3, 0), (0, 2, 100, 1), (50, 1, 100, 63), (50, 2, 0, 64), (100, 1, 0, 1), (100, 2, 3, 1)]
    assert hamming_topk.search(rows.limit(0), rows.limit(0)).count() == 0
