"""Language identification with hyperdimensional profiles.

Every code point has a fixed random vector of DIM values +1 or -1. A trigram's vector binds its letters' vectors, each
permuted (rotated) by its place, by multiplication; a document's vector bundles (adds) its distinct trigrams' vectors,
weighted by 1 + floor(log2(count)), so that a word said a thousand times does not drown the rest. A language's
prototype is the sum of its documents' vectors. A document gets the language whose prototype has the largest cosine
with its vector. Trigrams run over lower-cased letters with one blank between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import worker
from cairn.llm.common import bounded_batches, tidy
from cairn.llm.shingles import U, mix

DIM = 1024
#: Cosine below which keep() rejects a document: text in no learned language stays below it, prose of 50 words far above.
MIN_SCORE = 0.3
#: Documents bundled at once, their characters (one longer text is alone), and trigrams bound at once.
_BLOCK, _CHARS, _GRAMS = 128, 500_000, 4096

_letter = None


def _is_letter() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def _vectors(points: np.ndarray) -> np.ndarray:
    """The random vectors of code points: bits of a hash of the point and the word's number."""
    bits = mix(mix(points.astype(np.uint64)[:, None] + U(1)) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three code points of 21 bits) and their weights; none if the text has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
    points = np.where(_is_letter()[points], points, 0)
    padded = np.concatenate([[0], points, [0]]).astype(np.int64)
    padded = padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])]
    inner = padded[1:-1] != 0 if len(padded) > 2 else np.zeros(0, dtype=bool)
    if not inner.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32)
    grams, counts = np.unique(((padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:])[inner], return_counts=True)
    return grams, np.floor(np.log2(counts)).astype(np.float32) + 1


def bundles(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each text, and whether it has a letter."""
    found = [trigrams(t) for t in texts]
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    if not len(grams):
        return np.zeros((len(texts), DIM), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    weights = np.zeros((len(texts), len(grams)), dtype=np.float32)
    lengths = [len(g) for g, _ in found]
    weights[np.repeat(np.arange(len(texts)), lengths), at] = np.concatenate([w for _, w in found])
    total = np.zeros((len(texts), DIM), dtype=np.float32)
    for i in range(0, len(grams), _GRAMS):
        some = grams[i : i + _GRAMS]
        places = np.stack([some >> 42, (some >> 21) & 0x1FFFFF, some & 0x1FFFFF])
        points, place = np.unique(places, return_inverse=True)
        letters, place = _vectors(points), place.reshape(places.shape)
        bound = np.roll(letters, 2, axis=1)[place[0]] * np.roll(letters, 1, axis=1)[place[1]] * letters[place[2]]
        total += weights[:, i : i + _GRAMS] @ bound.astype(np.float32)
    return total, np.array(lengths) > 0


def _blocks(column):
    block, held = [], 0
    for i in range(0, len(column), _BLOCK):
        for text in column.slice(i, _BLOCK).to_pylist():
            n = len(text or "")
            if block and (len(block) == _BLOCK or held + n > _CHARS):
                yield block
                block, held = [], 0
            block.append(text)
            held += n
    if block:
        yield block


def _sums(batches):
    worker.forget()
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs, done = b.column("lang").to_pylist(), 0
        for block in _blocks(b.column("text")):
            vectors, _ = bundles(block)
            for lang, v in zip(langs[done : done + len(block)], vectors.astype(np.int64)):
                total[lang] = total.get(lang, 0) + v
            done += len(block)
    yield pa.RecordBatch.from_pydict({"lang": list(total), "total": [v.tolist() for v in total.values()]}, schema=pa.schema([("lang", pa.string()), ("total", pa.list_(pa.int64()))]))


def held_out():
    """True for documents that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame) -> dict[str, list[float]]:
    """Unit prototypes by language, from all labelled documents that are not held out; {} if there are none.

    Texts stay where they are read: a task makes one sum a language, these are added up by language and place, and one
    sum a language reaches the driver, whatever the table's size.
    """
    bounded_batches(docs.sparkSession)
    usable = tidy(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    parts = usable.select("lang", "text").mapInArrow(_sums, "lang string, total array<bigint>")
    sums = parts.select("lang", F.posexplode("total").alias("place", "v")).groupBy("lang", "place").agg(F.sum("v").alias("v"))
    total: dict[str, np.ndarray] = {}
    for row in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("total")).collect():
        total[row["lang"]] = np.array([x["v"] for x in row["total"]], dtype=np.int64)
    return {lang: (v / np.linalg.norm(v)).tolist() for lang, v in sorted(total.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns of docs with the predicted language and its score (cosine, 0 if negative); `und` and 0 without letters or languages."""
    bounded_batches(docs.sparkSession)
    names, matrix = list(prototypes), np.array(list(prototypes.values()), dtype=np.float64).reshape(len(prototypes), DIM).T

    def run(batches):
        worker.forget()
        for b in batches:
            preds, scores = [], []
            for block in _blocks(b.column("text")):
                vectors, known = bundles(block)
                vectors = vectors.astype(np.float64)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ matrix / np.where(norms > 0, norms, 1)[:, None]
                best = cosines.argmax(axis=1) if names else np.zeros(len(block), dtype=int)
                preds += [names[k] if ok and names else "und" for k, ok in zip(best, known)]
                scores += [min(1.0, max(0.0, float(c[k]))) if ok and names else 0.0 for c, k, ok in zip(cosines, best, known)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang, score])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{lang}` string, `{score}` double")


def identify(docs: DataFrame) -> DataFrame:
    """Predicted language of every document: doc_id, held_out, lang_pred, score.

    Takes doc_id, text and lang (null: not learned from); other columns are not read, and only text enters a
    prediction. A text that is null or has no letter is `und` with score 0, as is every text if no language was
    learned. A null doc_id counts as the empty string when held-out documents are drawn. Repeated rows and ties (the
    first language by code point) are deterministic; an empty table gives no rows.
    """
    rows = predict(tidy(docs, "doc_id", "text"), fit(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least min_score; a null lang becomes the predicted one.

    Prototypes are fitted to the labelled rows of docs; without any, every row stays, as nothing can be told.
    """
    prototypes = fit(docs)
    if not prototypes:
        return docs
    # Arrow maps can't name columns with dots, so columns that aren't read have plain names on the way
    names = [c if c in ("doc_id", "text", "lang") else f"extra_{i}" for i, c in enumerate(docs.columns)]
    found = predict(docs.toDF(*names), prototypes).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*names).toDF(*docs.columns)
