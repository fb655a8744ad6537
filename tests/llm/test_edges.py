"""Every operator and stage on odd rows and on an empty table."""

import pytest

import corpus_pipeline
from pawgrid.llm.op1_toxicity import score_documents
from pawgrid.llm.op2_fingerprints import fingerprint_documents
from pawgrid.llm.op3_source_mix import mix_sources, mixed_documents
from pawgrid.llm.op4_exact_topk import exact_topk
from pawgrid.llm.op5_ngram_join import jaccard_components, keep_one
from pawgrid.llm.op6_token_counts import token_counts
from pawgrid.llm.op7_secret_scan import redact_secrets, secret_scan
from pawgrid.llm.op8_best_fit_packing import best_fit_packing
from pawgrid.llm.op9_language_id import language_id
from pawgrid.llm.op10_lm_scoring import lm_scores

RUNS = {
    "fingerprints": lambda s, d: fingerprint_documents(d),
    "mix": lambda s, d: mix_sources(s, d),
    "mixed": lambda s, d: mixed_documents(s, d),
    "join": lambda s, d: jaccard_components(s, d),
    "keep": lambda s, d: keep_one(s, d),
    "tokens": lambda s, d: token_counts(s, d),
    "secrets": lambda s, d: secret_scan(d),
    "redact": lambda s, d: redact_secrets(d),
    "packing": lambda s, d: best_fit_packing(s, d),
    "language": lambda s, d: language_id(s, d),
    "lm": lambda s, d: lm_scores(s, d),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, nothing, name):
    assert RUNS[name](spark, nothing).collect() == []


def test_empty_toxicity_and_vectors(spark, nothing, no_labels):
    assert score_documents(spark, nothing, no_labels).collect() == []
    assert exact_topk(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


ONE_PER_ROW = ["fingerprints", "mix", "join", "tokens", "secrets", "redact", "language", "lm"]


@pytest.mark.parametrize("name", ONE_PER_ROW)
def test_odd_rows_keep_a_row_each(spark, odd, name):
    out = RUNS[name](spark, odd).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())


def test_odd_toxicity(spark, odd, no_labels):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (9, 0)], "doc_id long, toxic int")
    for marks in (labels, no_labels.select("doc_id", "toxic")):
        out = score_documents(spark, odd, marks).collect()
        assert len(out) == odd.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)


def test_odd_values(spark, odd):
    f = {(r["doc_id"], r["n_chars"]): r for r in RUNS["fingerprints"](spark, odd).collect()}
    assert f[3, 0]["fingerprint"] == f[4, 0]["fingerprint"] == "" and f[5, 4]["fingerprint"] == ""
    assert len(f[7, 50_000]["fingerprint"]) == 256
    c = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in RUNS["join"](spark, odd).collect()}
    assert {(1, 7, 1), (2, 7, 1), (2, 2, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 1, None), (None, 0, None)} <= c
    assert (10, 1, 10) in c and (11, 1, 10) in c  # short texts are one sequence; A-Z is lower-cased
    lang = {r["doc_id"]: r for r in RUNS["language"](spark, odd).collect()}
    assert all(lang[k]["lang_pred"] == "und" and lang[k]["score"] == 0 for k in (3, 4, 5, 9))
    lm = {r["doc_id"]: r for r in RUNS["lm"](spark, odd).collect()}
    assert lm[3]["n_tokens"] == lm[4]["n_tokens"] == lm[5]["n_tokens"] == 1 and lm[6]["n_tokens"] == 60_001
    mix = RUNS["mix"](spark, odd).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mix)


def test_keep_one_and_mixed_keep_the_columns(spark, odd):
    kept = keep_one(spark, odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum(r["text"] is not None and r["text"].startswith("the cat") for r in rows) == 1
    assert sum(r["text"] == "text without a number" for r in rows) == 1
    assert sum(r["text"] in (None, "", " \t\n ") for r in rows) == 4  # nothing to link: all stay
    assert sum(r["text"] in ("a b c", "A B C") for r in rows) == 1
    assert mixed_documents(spark, odd).columns == odd.columns
    assert redact_secrets(odd).columns == odd.columns


def test_vectors_with_nulls_ties_and_sizes(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.5, 0.5]),
            (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (11, [1.0, 2.0, 3.0]), (100, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk(spark, df, k=2).collect())
    assert out == [(0, 1, 3, 65536), (0, 2, 7, 65536), (50, 1, 9, 32768), (50, 2, 0, 0), (100, 1, 11, 6 * 65536)]


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, nothing):
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs_out = step(spark, docs, str(tmp_path))
            assert docs_out.columns == docs.columns
            docs_out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
