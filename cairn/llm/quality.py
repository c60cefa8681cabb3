"""Quality rules of documents and of their hosts, in DataFrame functions only.

Document rules: too few words, or more than half of the words in repeated 3-word windows (the base rules); a share of
symbols, of repeated lines among the lines with a word, or a mean word length out of range (the further rules). A host's failures are its documents
that fail any rule. Hosts get a beta prior fitted to all hosts by the method of moments; a host's failure rate is the
mean of its beta posterior, so that a host with few documents leans on the rest. A document is kept if it passes the
base rules and its host's rate is at most `host_limit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, SALTS, SPACE, SPACE_CHARS, cut, join_sized, let, tidy, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Further rules, counted against hosts.
MAX_SYMBOL_PERCENT, MAX_DUP_LINES_PERCENT, MIN_MEAN_WORD, MAX_MEAN_WORD = 10, 30, 3, 12
#: A host is rejected above this shrunk failure rate.
HOST_LIMIT = 0.5


def repeated_words(w: Column, size: int = 3) -> Column:
    """Words that lie in a window of `size` words found twice or more in the array, the first occurrence included."""
    last = F.size(w) - F.lit(size)

    def marked(keys: Column) -> Column:
        # windows sorted by text, then place: equal neighbours are repeats
        def places(s: Column) -> Column:
            hit = F.filter(s, lambda x, i: ((i > 0) & (x["k"] == F.get(s, i - 1)["k"])) | (x["k"] == F.get(s, i + 1)["k"]))
            starts = F.sort_array(F.transform(hit, lambda x: x["i"]))
            return let(starts, covered)

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(size)), F.lit(size)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        sort = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(sort, places))

    keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(size))))
    return F.when(last >= 0, let(keys, marked)).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, and the word, symbol, line and repetition counts of every whole text (null text: no words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    counted = docs.select(
        "doc_id",
        "source",
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
    )
    return counted.select(
        "doc_id", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words")
    )


def hosts(measured: DataFrame) -> DataFrame:
    """One row a host: source, host_docs, host_failures, host_rate (posterior mean under the empirical beta prior)."""
    by = measured.groupBy("source").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failures"))
    by = cut(by)
    rate = F.col("host_failures") / F.col("host_docs")
    prior = by.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("noise"))
    # spread of the hosts' true rates: what is beyond binomial noise, at least a little, so that the prior stays proper
    m = F.least(F.greatest(F.coalesce("m", F.lit(0.5)), F.lit(0.001)), F.lit(0.999))
    spread = F.greatest(F.coalesce("v", F.lit(0.0)) - m * (1 - m) * F.col("noise"), m * (1 - m) / 1000)
    strength = F.greatest(m * (1 - m) / spread - 1, F.lit(1.0))
    prior = prior.select((m * strength).alias("a"), strength.alias("s"))
    return by.join(F.broadcast(prior)).select("source", "host_docs", "host_failures", ((F.col("host_failures") + F.col("a")) / (F.col("host_docs") + F.col("s"))).alias("host_rate"))


def quality(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Measures and verdicts of every document.

    Takes doc_id, text and source; other columns are not read. Returns a row per input row: doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failures, host_rejected, kept.
    A null or empty text has no words and fails. Documents with a null source share one null host. Repeated rows count
    each. An empty table gives no rows.
    """
    return _judged(docs, host_limit).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_docs", "host_failures", "host_rejected", "kept"
    )


def keep(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs, all columns, that quality() keeps.

    Base rules are tested again on each row, and hosts' verdicts are joined by source, so that texts are not shuffled
    for the rejected rows' sake, however many these are.
    """
    verdicts = hosts(_failures(docs)).select("source", (F.col("host_rate") > host_limit).alias("host_rejected"))
    rejected = cut(verdicts.where("host_rejected").select("source"))
    if rejected.count() <= BROADCAST_ROWS:
        out = docs.join(F.broadcast(rejected), docs["source"].eqNullSafe(rejected["source"]), "left_anti")
    else:  # a host's rows are dealt to SALTS tasks by their texts
        shares = rejected.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        share = F.pmod(F.xxhash64(docs["text"]), F.lit(SALTS)).cast("int")
        out = docs.join(shares, docs["source"].eqNullSafe(shares["source"]) & (share == shares["share"]), "left_anti")
    failed = let(words(docs["text"]), lambda w: F.when(F.size(w) < MIN_WORDS, True).otherwise(100 * repeated_words(w) > MAX_REPEAT_PERCENT * F.size(w)))
    return out.where(~failed)


def _failures(docs: DataFrame) -> DataFrame:
    """measures() with base_failed and failed (any rule), cut."""
    m = measures(tidy(docs, "doc_id", "text", "source"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    further = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < MIN_MEAN_WORD * F.col("n_words"))
        | (F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words"))
    )
    return cut(m.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | further))


def _judged(docs: DataFrame, host_limit: float) -> DataFrame:
    m = _failures(docs)
    verdicts = hosts(m).select("source", "host_docs", "host_failures", (F.col("host_rate") > host_limit).alias("host_rejected"))
    out = join_sized(m, cut(verdicts), "source", salt="doc_id")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


#: The same rows in SQL for DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         row_number() OVER () AS rid
  FROM documents),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + d) AS r FROM hit, range(3) AS o(d) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS nl, count(*) - count(DISTINCT l) AS d
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(nl, 0)::BIGINT AS n_lines, coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS failed FROM b),
h AS (SELECT source, count(*) AS host_docs, sum(failed::BIGINT)::BIGINT AS host_failures FROM f GROUP BY source),
p AS (
  SELECT least(greatest(coalesce(avg(host_failures::DOUBLE / host_docs), 0.5::DOUBLE), 0.001::DOUBLE), 0.999::DOUBLE) AS m,
         coalesce(var_samp(host_failures::DOUBLE / host_docs), 0::DOUBLE) AS v, avg(1::DOUBLE / host_docs) AS noise FROM h),
s AS (SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * noise, m * (1 - m) / 1000) - 1, 1::DOUBLE) AS s FROM p),
v AS (SELECT source, host_docs, host_failures, (host_failures + m * s) / (host_docs + s) > 0.5 AS host_rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failures, host_rejected,
       NOT base_failed AND NOT host_rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
