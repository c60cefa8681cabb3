"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment confirms them.

DataFrame functions only. Words are lower-cased and lose punctuation at their ends. Shingles have five words. A text's
windows hold WINDOW shingles and start at every STRIDE-th, so that neighbours share one and any two shingles in a row lie
in one window; a template's hold two and start at every shingle. A window gets a MinHash value for each of BANDS orders
of the hashes, and each is a band of one row; a text window that shares a band with a template's window retrieves that
template. Which of three hashes comes first under an exclusive or with a seed hangs on two bits of the seed at most; the
seeds have all four values at every two places, so that every shingle of a window is its least for some seed. So windows
share a band for certain if one holds all of the other, which independent orders reach with 0.9997 by 20 bands in the
case of one shingle of three: one-shingle templates, and any two shingles of a template in a row, are found for certain.
A template of LONG shingles or more is indexed under LONG_BANDS orders only, and found for certain by any four in a row.
A retrieved template matches if the text holds at least MIN_CONTAINED percent of the template's distinct shingles.

The templates' bands are one row of buckets that every task holds, bounded by PART_SHINGLES; more templates are scanned
for in several parts. Retrieval and confirmation are a projection of a text's row; no text is shuffled.
"""

from __future__ import annotations

import functools
import itertools
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import SPACE_CHARS, let, tidy

#: Notices by which public licenses ask to be referred to.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-redistribution": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}
SHINGLE = 5
WINDOW, STRIDE, BANDS = 3, 2, 10
LONG, LONG_BANDS = 16, 4
MIN_CONTAINED = 80
#: Shingles of the templates that one scan looks for: about 8 MB of bands.
PART_SHINGLES = 200_000
_BUCKETS = 1 << 16
_TEXTS = Path(__file__).parent / "licenses"
_EDGE = ".,;:!?\"'()[]"
_GAP = r"""[.,;:!?"'()\[\]]*[\x20\x09-\x0D]+[.,;:!?"'()\[\]\x20\x09-\x0D]*"""
#: A row of BANDS bits for each of 64 places: the first 0, and 5 of the others 1, no two alike. In any two rows all of
#: 00, 01, 10 and 11 stand one above the other somewhere.
_PLACES = list(itertools.combinations(range(1, BANDS), BANDS // 2))[31:95]
#: Each orders the shingles' hashes anew by exclusive or.
_SEEDS = [s - (1 << 64) if s >> 63 else s for s in (sum(1 << p for p, on in enumerate(_PLACES) if k in on) for k in range(BANDS))]


def _words(text: Column) -> Column:
    bare = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_EDGE + SPACE_CHARS))
    return F.filter(F.split(bare, _GAP), lambda w: w != "")


def _shingles(w: Column, of) -> Column:
    """of(five words) for every place of the array; none for fewer words."""
    starts = F.sequence(F.lit(0), F.size(w) - SHINGLE)
    return F.when(F.size(w) >= SHINGLE, F.transform(starts, lambda i: of(*(F.get(w, i + k) for k in range(SHINGLE))))).otherwise(F.array())


def _bands(hashes: Column, width: int, stride: int, seeds: int) -> Column:
    """The bands of all windows: for each seed the least hash of `width` neighbours, marked with the seed."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - (width - stride), F.lit(1)) - 1, F.lit(stride))

    def row(seed: int) -> Column:
        return F.transform(starts, lambda i: F.least(*(F.get(hashes, i + k).bitwiseXOR(F.lit(seed)) for k in range(width))))

    return F.when(F.size(hashes) > 0, F.concat(*(row(seed) for seed in _SEEDS[:seeds]))).otherwise(F.array().cast("array<bigint>"))


def _text_bands(text: Column, of) -> Column:
    """of(a band's hashes) over a text: the bands of its windows."""
    return let(_words(text), lambda w: let(_shingles(w, F.xxhash64).cast("array<bigint>"), of))


def _word_shingles(text: Column) -> Column:
    return let(_words(text), lambda w: _shingles(w, lambda *parts: F.concat_ws(" ", *parts)))


def whole_texts() -> dict[str, str]:
    """Whole public license texts, without title and copyright lines: name and text."""
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(_TEXTS.glob("*.txt"))}


def default_templates() -> dict[str, str]:
    """The notices and the whole texts."""
    return NOTICES | whole_texts()


def _parts(templates: dict[str, str]):
    """Templates by name, a new part wherever a multiple of PART_SHINGLES words is passed."""
    ends = itertools.accumulate(len(t.split()) for _, t in sorted(templates.items()))
    for _, part in itertools.groupby(zip(ends, sorted(templates.items())), lambda e: e[0] // PART_SHINGLES):
        yield [item for _, item in part]


def _index(spark: SparkSession, part: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Two frames of one row: buckets, each with the (band, t) whose bands fall in it, and the templates (name, shingles) by t."""
    known = spark.createDataFrame([(t, *item) for t, item in enumerate(part)], "t int, name string, text string")
    known = known.select("t", "name", F.array_distinct(_word_shingles(F.col("text"))).alias("shingles"), F.col("text"))
    seeds = lambda h: F.when(F.size(h) < LONG, _bands(h, WINDOW - STRIDE + 1, 1, BANDS)).otherwise(_bands(h, WINDOW - STRIDE + 1, 1, LONG_BANDS))
    bands = known.select("t", F.explode(F.array_distinct(_text_bands(F.col("text"), seeds))).alias("band"))
    filled = bands.groupBy(_bucket(F.col("band")).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("band", "t"))).alias("held"))
    all_buckets = spark.range(_BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(filled, "bucket", "left")
    none = F.array().cast("array<struct<band: bigint, t: int>>")
    buckets = all_buckets.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("held", none).alias("held"))))["held"].alias("buckets"))
    return buckets, known.agg(F.sort_array(F.collect_list(F.struct("t", "name", "shingles"))).alias("known"))


def _bucket(band: Column) -> Column:
    return band.bitwiseAND(F.lit(_BUCKETS - 1)).cast("int")


def _retrieved(text: Column, buckets: Column) -> Column:
    """The t of every template that shares a band with a window of the text."""

    def look(table: Column) -> Column:
        at = lambda b: F.get(table, _bucket(b))
        hits = lambda h: F.filter(_bands(h, WINDOW, STRIDE, BANDS), lambda b: F.exists(at(b), lambda e: e["band"] == b))
        found = _text_bands(text, hits)
        return F.array_distinct(F.flatten(F.transform(found, lambda b: F.transform(F.filter(at(b), lambda e: e["band"] == b), lambda e: e["t"]))))

    return let(buckets, look)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, min_contained: int = MIN_CONTAINED) -> DataFrame:
    """Templates that documents hold: a row per document and matching template.

    Takes doc_id and text; other columns are not read. Templates are a parameter: a dict of name to text of five words
    or more, by default notices and whole license texts. Returns doc_id, license, template_shingles, found_shingles
    (distinct ones of the template that the text holds). A null, empty or short text matches nothing; repeated rows give
    repeated results; an empty table gives no rows. A template of fewer than five words is never found.
    """
    spark = docs.sparkSession
    rows = tidy(docs, "doc_id", "text")
    found = [_matches(rows, *_index(spark, part), min_contained) for part in _parts(default_templates() if templates is None else templates)]
    return functools.reduce(DataFrame.unionAll, found)


def _matches(docs: DataFrame, buckets: DataFrame, known: DataFrame, min_contained: int) -> DataFrame:
    """Matches of the templates of one index, whose two one-row frames are read as scalars."""
    held = docs.select("doc_id", "text", buckets.scalar().alias("buckets"))
    held = held.select("doc_id", "text", _retrieved(F.col("text"), F.col("buckets")).alias("ts"))
    # a generated column is computed once; a projected one would be repeated in the filter and in each template's test
    found = held.select("doc_id", "text", F.explode_outer(F.array("ts")).alias("ts")).where(F.size("ts") > 0)
    found = found.select("doc_id", "text", F.explode("ts").alias("t"))
    found = found.select("doc_id", "text", F.get(known.scalar(), F.col("t")).alias("known"))
    held = F.size(F.array_intersect(F.col("known.shingles"), _word_shingles(F.col("text"))))
    found = found.select("doc_id", F.col("known.name").alias("license"), F.size("known.shingles").cast("long").alias("template_shingles"), held.cast("long").alias("found_shingles"))
    return found.where(F.lit(100) * F.col("found_shingles") >= F.lit(min_contained) * F.col("template_shingles"))


def sql(templates: dict[str, str] | None = None) -> str:
    """Containment of every template in every text, in SQL for DuckDB."""
    names = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((default_templates() if templates is None else templates).items()))
    gap, edge = _GAP.replace("'", "''"), (_EDGE + SPACE_CHARS).replace("'", "''")
    ws = f"list_filter(regexp_split_to_array(trim(lower(coalesce(text, '')), '{edge}'), '{gap}'), lambda w: w <> '')"
    cut = "unnest(list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4]))"
    return f"""
WITH t AS (SELECT DISTINCT name, {cut} AS s FROM (SELECT name, {ws} AS ws FROM (VALUES {names}) v(name, text))),
n AS (SELECT name, count(*) AS n FROM t GROUP BY name),
d AS (SELECT DISTINCT rid, doc_id, {cut} AS s FROM (SELECT row_number() OVER () AS rid, doc_id, {ws} AS ws FROM documents))
SELECT doc_id, name AS license, n AS template_shingles, count(*) AS found_shingles
FROM d JOIN t USING (s) JOIN n USING (name) GROUP BY rid, doc_id, name, n HAVING 100 * count(*) >= {MIN_CONTAINED} * n
"""
