"""The pipeline against a plain run of its stages on a small table."""

import re
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bpe, langid, minhash, mixing, quality
from tests.llm.test_pairs import shingles, smallest

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs.collect())
        if i < 4:
            assert docs.columns == before.columns
    first = {r["doc_id"] for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in out[0]} == first and len(first) > 150
    assert {r["doc_id"] for r in out[1]} <= first
    second = sorted(r["doc_id"] for r in out[1])
    sets = [shingles(rows[d]["text"]) for d in second]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert sorted(r["doc_id"] for r in out[2]) == [d for i, d in enumerate(second) if smallest(len(second), linked)[i] == i]
    taken = mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()
    assert Counter(r["doc_id"] for r in out[3]) == Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in taken if int(r["taken"] / r["size"] + 0.5)})
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out[4]) == Counter((r["doc_id"], len(enc.encode_ordinary(rows[r["doc_id"]]["text"]))) for r in out[3])


def test_run_and_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    n = corpus_pipeline.run(spark, SF).count()
    assert n == corpus_pipeline.run(spark, SF).count() > 100


def test_keeping_stages_with_clashing_columns(spark):
    """Extra columns named as the stages' own, or with a dot, come out as they went in."""
    text = lambda n: " ".join(f"the word{n}of{i} and more{i}" for i in range(40))
    rows = [(i, text(max(i, 1)), "en", f"s{i % 2}", 9) for i in range(6)] + [(2, text(2), None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("__id", "__lang", "__score", "LANG_PRED", "lang_score", "__copies", "__key", "row", "a.b")
    wide = docs.select("*", *(F.lit(k).alias(name) for k, name in enumerate(extra)))
    for stage in (quality.keep, langid.keep, minhash.keep, mixing.apply):
        out = stage(wide)
        assert out.columns == wide.columns
        assert {tuple(r[5:]) for r in out.collect()} == {tuple(range(len(extra)))}
        assert out.count() == stage(docs).count()
