"""Language identification, BPE, packed ids: held-out accuracy, the public libraries, round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from cairn.llm import binpack, bpe, common, langid

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n  \n", "a", "don't STOP", "é́ 一二 12345 <|endoftext|>", "\x1c\x85\xa0 x\x00y", "=" * 5000, "ab" * 3000, "x " * 20_000, "end.", "End, end.. .,", "A.", "İΣ ẞ", "same", "same"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)


def test_language_profiles_by_hand(spark):
    """Letter by letter: rotate, multiply, add, and the cosine with sums of the learned texts' vectors."""
    words = {"en": "the cat and dog sat on a mat in old town by sea".split(), "fr": "le chat et un chien sur une natte dans la vieille ville".split()}
    random.seed(8)
    rows = [(i, " ".join(random.choices(words[lang], k=random.choice((1, 3, 30, 60)))) + random.choice(("", "!", " 12", "\n\n")), lang if i % 5 else None) for i in range(80) for lang in [random.choice(["en", "fr"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def vector(text):
        text = "".join(c if c.isalpha() else " " for c in text.lower())
        text, counts = " " + " ".join(text.split()) + " ", {}
        for i in range(len(text) - 2):
            if text[i + 1] != " ":
                counts[text[i : i + 3]] = counts.get(text[i : i + 3], 0) + 1
        total = [0] * langid.DIM
        for gram, n in counts.items():
            a, b, c = (langid._vectors(np.array([0 if x == " " else ord(x)]))[0].astype(int).tolist() for x in gram)
            for i in range(langid.DIM):
                total[i] += a[i - 2] * b[i - 1] * c[i] * (1 + int(np.log2(n)))
        return np.array(total, dtype=float)

    learned = {}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[lang] = learned.get(lang, 0) + vector(text)
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for i, text, _ in rows:
        v = vector(text)
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in learned.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert found[i]["lang_pred"] == best and found[i]["score"] == pytest.approx(max(0.0, cosines[best]))


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame(
        [(0, "the cat and the dog", "en", 1), (1, "le chat et le chien", "fr", 1), (3, None, "en", 1), (4, "", None, 1), (5, "123 !?", "fr", 1), (6, "the the", None, 1), (None, "le", None, 1), (7, "the " * 50_000, "en", 1), (7, "the " * 50_000, "en", 1)],
        "doc_id long, text string, lang string, score int",
    )
    found = langid.identify(docs).collect()
    assert len(found) == 9 and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r for r in found}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == "und" and by[3]["score"] == 0
    assert {r["doc_id"] for r in found if r["held_out"]} == {d for d in by if zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2}
    assert langid.identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang is null")).collect()} <= {"und"}
    kept = langid.keep(docs)
    assert kept.columns == docs.columns and kept.where("text is null or lang is null").count() == 0


def test_language_learns_from_its_share_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    hidden = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert {tuple(r) for r in langid.identify(hidden).collect()} == {tuple(r) for r in langid.identify(docs).collect()}


def test_small_language_in_a_large_table_is_learned(spark):
    from pyspark.sql import functions as F

    ids = spark.range(100_000).withColumnRenamed("id", "doc_id")
    # a share of the table by a hash of doc_id would take these last
    few = [r["doc_id"] for r in ids.where(~langid.held_out()).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).desc()).limit(3).collect()]
    small = F.col("doc_id").isin(few)
    docs = ids.withColumn("text", F.when(small, F.lit("кот и пёс у дома")).otherwise(F.lit("the cat and dog"))).withColumn("lang", F.when(small, F.lit("ru")).otherwise(F.lit("en")))
    assert sorted(langid.fit(docs)) == ["en", "ru"]
    assert {r["doc_id"] for r in langid.identify(docs).where("lang_pred = 'ru'").collect()} == set(few)
    assert {r["doc_id"] for r in langid.keep(docs).where("lang = 'ru'").collect()} == set(few)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_query_rows(spark, reference):
    rows = bpe.decode(bpe.encode(frame(spark, ODD), RANKS, PATTERN), RANKS, PATTERN).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD):
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == reference.encode_ordinary(t or "")
        assert r["n_tokens"] == len(r["ids"]) // 4 and r["decoded"] == (t or "").encode()
    none = bpe.encode(frame(spark, ODD).where("false"), RANKS, PATTERN)
    assert bpe.decode(none, RANKS, PATTERN).count() == 0


def test_bpe_against_the_library(reference):
    random.seed(3)
    b = bpe.Bpe(bpe.read_ranks(RANKS), PATTERN)
    letters = [97, 98, 116, 104, 101, 32, 10, 39, 115, 49, 46, 0xE9, 0x4E00, 0x1F600, 0x85, 0]
    texts = ["".join(chr(random.choice(letters)) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(random.choice("etaoin") for _ in range(n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 300, 2000)] + ["a" * n for n in range(1, 200)]
    ids = b.encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert list(b.decode(ids)) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        list(b.decode([np.array([60_000], dtype="<u4").tobytes()]))


def test_bpe_of_long_pieces(reference):
    """Random letters, few letters, runs, and text of any script without blanks: in spans, spans that follow, and whole."""
    random.seed(6)
    b = bpe.Bpe(bpe.read_ranks(RANKS), PATTERN)
    some = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ACGT", "ABab", "\u4e00\u4e8c\u4e09\u00e9", "=", "ab", "01", " ", "-=", "\n"]
    texts = ["".join(random.choices(x, k=n)) for x in some for n in (63, 64, 65, 95, 96, 97, 128, 1024, 1025, 20_000)]
    texts += ["ab" * 20_000 + "".join(random.choices("ab", k=3000)) + "-" * 5000 + "=" * 5000 + "-=" * 700, "the" * 5000 + "operation" * 3000, "a" * 1_000_000]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in b.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert all(len(p) <= bpe._SHORT for p in b.known.new)


def test_bpe_without_a_common_token(reference, monkeypatch):
    """Whole pieces, where spans and spans that follow disagree."""
    b = bpe.Bpe(bpe.read_ranks(RANKS), PATTERN)
    monkeypatch.setattr(b, "_joined", lambda spans: None)
    texts = ["a" * 500, "ACGT" * 30, "operationsofthe" * 10]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in b.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_in_bounded_steps(reference, monkeypatch):
    monkeypatch.setattr(bpe, "_ROWS", 1)
    b = bpe.Bpe(bpe.read_ranks(RANKS), PATTERN)
    texts = ["internationalization of heterogeneous", "qzx" * 40]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in b.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_documents_as_the_library_encodes_them(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.encode(docs, RANKS, PATTERN).collect():
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == reference.encode_ordinary(texts[r["doc_id"]] or "")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    raw = binpack.pack(ids, bits)
    assert len(raw) == (1001 * bits + 7) // 8 and (binpack.unpack(raw, 1001, bits) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError):
            binpack.pack(np.array([1 << bits], dtype="<u4"), bits)


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 1, 7, 100, 0, 63)]
    with open(tmp_path / "f", "wb") as f:
        w = binpack.Writer(f, bits, block=10)
        for i, d in enumerate(docs):
            w.add(pa.array([i]), d, np.array([len(d)]))
        assert w.close() == (6, 171)
    from pyarrow import OSFile

    r, flat = binpack.Reader(OSFile(str(tmp_path / "f"))), np.concatenate(docs)
    for a, b in ((0, 171), (0, 0), (9, 11), (10, 20), (170, 171), (33, 99)):
        assert (r.ids(a, b) == flat[a:b]).all()
    assert binpack.width(49_408) == 16 and binpack.width(1) == 1


def test_packed_files(spark):
    for by_word in (False, True):
        listed = binpack.write(frame(spark, ODD), common.new_dir(spark, "t"), WORD_BPE, 49_408, 2, by_word)
        rows = binpack.read(spark, listed).orderBy("doc_id").collect()
        tok, start = Tokenizer.from_file(WORD_BPE), 0
        for r, t in zip(rows, ODD, strict=True):
            want = tok.encode(t or "", add_special_tokens=False).ids + [2]
            assert np.frombuffer(r["ids"], dtype="<u4").tolist() == want and (r["start"], r["n_tokens"]) == (start, len(want))
            start += len(want)
    empty = frame(spark, ODD).where("false")
    assert binpack.read(spark, binpack.write(empty, common.new_dir(spark, "t"), WORD_BPE, 49_408, 2)).count() == 0
    odd = spark.createDataFrame([(None, "b"), (2, "a"), (2, "a"), (1, None), (-(1 << 63), "c"), (None, None)], "doc_id long, text string")
    rows = binpack.read(spark, binpack.write(odd, common.new_dir(spark, "t"), WORD_BPE, 49_408, 2)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, -(1 << 63), 1, 2, 2]


def test_many_rows_of_one_doc_id(spark):
    """They are dealt to several files, and keep their order."""
    docs = spark.range(4000, numPartitions=4).selectExpr("7L as doc_id", "concat('a', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listed = binpack.write(docs, common.new_dir(spark, "t"), WORD_BPE, 49_408, 2, True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = binpack.read(spark, listed).orderBy("start").collect()
    tok = Tokenizer.from_file(WORD_BPE)
    assert len(listed) > 1 and [np.frombuffer(r["ids"], dtype="<u4").tolist() for r in rows] == [tok.encode(f"a{i}", add_special_tokens=False).ids + [2] for i in range(4000)]


def test_added_tokens_as_the_library_reads_them():
    tok = Tokenizer.from_file(WORD_BPE)
    texts = [f"{a}{t}{b}" for t in ("<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|endoftext|><|startoftext|>") for a in ("", " ", "hello ", "Hel", "é", "don't", "x.") for b in ("", " world", "World", "'s", "\0", ", it")]
    assert binpack.WordEncoder(WORD_BPE, True).encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_simple_words_as_the_library_reads_them():
    random.seed(5)
    letters = [chr(c) for c in range(0x21, 0x180) if c not in range(0x7F, 0xA0)] + list("'sStTreEllmMd    ") * 4
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(5000)]
    tok, words = Tokenizer.from_file(WORD_BPE), binpack.WordEncoder(WORD_BPE, True)
    assert words.pattern is not None
    assert words.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_remembered_words_are_dropped_by_halves(monkeypatch):
    monkeypatch.setattr(binpack, "_REMEMBERED", 40)
    words, whole = binpack.WordEncoder(WORD_BPE, True), binpack.WordEncoder(WORD_BPE, False)
    for i in range(60):
        texts = [f"W{i % 17} a{i}, the b{i}. naïve{i % 5}" for _ in range(3)] + [None]
        assert words.encode(texts) == whole.encode(texts)
        assert len(words.known.new) + len(words.known.old) < 120


def test_words_alone_are_words_in_texts():
    random.seed(4)
    letters = [97, 65, 32, 10, 0x1C, 0x85, 0xA0, 0x200B, 0x301, 0x327, 0x130, 0x3A3, 0x1100, 0x1161, 39, 115, 46, 44, 49, 0, 0x660]
    texts = ["".join(chr(random.choice(letters)) for _ in range(random.randint(0, 25))) for _ in range(5000)]
    whole, parts = binpack.WordEncoder(WORD_BPE, False), binpack.WordEncoder(WORD_BPE, True)
    assert whole.encode(texts) == parts.encode(texts)


def test_capitals_with_combining_marks_as_in_texts():
    marks = [chr(m) for m in range(0x300, 0x370)]
    texts = [f"{a}{m}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks for b in ("olon", "a.", "A,")]
    texts += ["H\u0331olon T\u0308a J\u030ca W\u030aa, Y\u030aa."]
    whole, parts = binpack.WordEncoder(WORD_BPE, False), binpack.WordEncoder(WORD_BPE, True)
    assert whole.encode(texts) == parts.encode(texts)
