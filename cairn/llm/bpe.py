"""Byte-level BPE: encoding by recursive DuckDB queries in every partition, decoding by ordered aggregation.

A rank file gives tokens and ranks. Texts are cut by the tokenizer's pattern; each distinct piece of a task's batches
is encoded once. In DuckDB, pieces are token-position rows. A recursive query joins neighbouring tokens to the merge
table and contracts, in every piece, the leftmost pair of least rank, until no pair is in the table.

Long pieces (over LONG bytes) are cut into overlapping spans of SPAN bytes, which are pieces for that query, and joined
at a token that two neighbouring spans agree on. This is exact: a list of tokens is what greedy merging gives if and
only if it gives each two neighbours back from their own bytes (the first merge across any border would also happen
between these two alone), and up to the common token all neighbours are those of one span, from it on those of the
other. Where two spans agree on no token, as in periodic text, longer spans follow each other, each beginning where a
token of the one before begins. If even these disagree, the whole piece goes through a form of the query that contracts
all non-overlapping places of the least pair in one step where this provably gives the same tokens: the merged token
can't start or end a pair of lower rank. So time and memory grow in proportion to a piece's length but for the last case.

A query takes at most PIECES pieces and about BYTES bytes and runs a bounded number of steps, so that its accumulated
rows stay bounded; the next goes on with what is left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import worker
from cairn.llm.common import bounded_batches, tidy

#: Pieces encoded by one recursive query, their bytes, and the bytes from which a piece is long.
PIECES, BYTES, LONG = 20_000, 400_000, 64
#: Bytes of a span of a long piece; each begins half a span after the one before. Bytes of a span in periodic text.
SPAN, FOLLOWING = 64, 1024
#: Accumulated rows of one recursive query, about.
_ROWS = 2_000_000
#: Encoded pieces that a Python worker remembers; longer ones than _SHORT bytes are forgotten after their batch.
_REMEMBERED, _SHORT = 600_000, 200
#: Tokens decoded by one query.
_DECODED = 500_000

_SHORT_STEP = """
(WITH s AS MATERIALIZED (
  SELECT n.*, m::BIGINT << 32 | pos AS key
  FROM (SELECT *, CASE WHEN lead(w) OVER o = w THEN lead(tok) OVER o END AS nxt, CASE WHEN lag(w) OVER o = w THEN lag(pos) OVER o END AS prv
        FROM step WHERE live AND it < ? WINDOW o AS (ORDER BY pos)) n
  LEFT JOIN merges ON l = tok AND r = nxt)
SELECT s.w, pos, CASE WHEN pos = (best & 4294967295)::INTEGER THEN (best >> 32)::INTEGER ELSE tok END AS tok, (it + 1)::INTEGER AS it, best IS NOT NULL AS live
FROM s JOIN (SELECT w, min(key) AS best FROM s GROUP BY w) b ON b.w = s.w
WHERE best IS NULL OR prv IS NULL OR prv <> (best & 4294967295)::INTEGER)
"""
_LONG_STEP = """
SELECT w, pos, CASE WHEN taken THEN (best >> 32)::INTEGER ELSE tok END AS tok, (it + 1)::INTEGER AS it, best IS NOT NULL AS live
FROM (
  SELECT *, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
  FROM (
    SELECT *, hit AND (pos = best & 4294967295 OR (safe AND (i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1)) AS taken
    FROM (
      SELECT *, coalesce(m = best >> 32, false) AS hit
      FROM (
        SELECT *, min(m::BIGINT << 32 | pos) OVER (PARTITION BY w) AS best
        FROM (SELECT s.*, m, safe FROM (SELECT *, lead(tok) OVER o AS nxt, row_number() OVER o AS i FROM step WHERE live AND it < ? WINDOW o AS (PARTITION BY w ORDER BY pos)) s
              LEFT JOIN merges ON l = tok AND r = nxt)))))
WHERE NOT gone
"""


def _query(step: str) -> str:
    return f"WITH RECURSIVE step AS (SELECT w, pos, tok, 0::INTEGER AS it, true AS live FROM init UNION ALL {step}) SELECT w, pos, tok, live FROM step WHERE NOT live OR it = ? ORDER BY pos"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and a number a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """One tokenizer in one process: its pattern, merge table and remembered pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.known = worker.Recent(_REMEMBERED)
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.length[list(ranks.values())] = [len(t) for t in ranks]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        rows = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, m = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        later = np.full(max(ranks.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(later, l, m)
        np.minimum.at(later, r, m)
        merges = pa.table({"l": l, "r": r, "m": m, "safe": later[m] > m})  # noqa: F841
        pieces = pa.table({"id": list(ranks.values()), "piece": ["".join(chr(256 + b) for b in t) for t in ranks]})  # noqa: F841
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "384MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE merges AS SELECT l::INTEGER AS l, r::INTEGER AS r, m::INTEGER AS m, safe FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT id::INTEGER AS id, piece FROM pieces")

    def _contract(self, init: pa.Table, step: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and tokens at the fixpoint, by place."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while init.num_rows:
            steps = max(4, _ROWS // init.num_rows)
            found = self.db.execute(_query(step), [steps, steps]).fetchnumpy()
            live = np.asarray(found["live"])
            done.append((found["pos"][~live], found["tok"][~live]))
            init = pa.table({k: found[k][live] for k in ("w", "pos", "tok")})
        pos, tok = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(pos, kind="stable")
        return pos[order], tok[order]

    def _encode(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces, in queries of bounded size."""
        out = {}
        for long in (False, True):
            some, held = [], 0
            for b in [*(b for b in parts if (len(b) > LONG) == long), None]:
                if some and (b is None or len(some) == PIECES or held + len(b) > BYTES):
                    ends = np.cumsum([len(x) for x in some])
                    tokens = self.byte[np.frombuffer(b"".join(some), dtype=np.uint8)]
                    words = np.repeat(np.arange(len(some), dtype=np.int32), np.diff(ends, prepend=0))
                    pos, tok = self._contract(pa.table({"w": words, "pos": np.arange(len(tokens), dtype=np.int32), "tok": tokens}), _LONG_STEP if long else _SHORT_STEP)
                    cut = np.searchsorted(pos, ends).tolist()
                    flat = tok.astype("<u4").tobytes()
                    out.update((x, flat[4 * start : 4 * end]) for x, start, end in zip(some, [0, *cut[:-1]], cut))
                    some, held = [], 0
                if b is not None:
                    some.append(b)
                    held += len(b)
        return out

    def _tokens(self, at: int, ids: bytes) -> tuple[list[int], list[int], list[int]]:
        """Tokens, their first places and their ends, of a span that begins at `at`."""
        tokens = np.frombuffer(ids, dtype="<u4")
        ends = at + np.cumsum(self.length[tokens])
        return tokens.tolist(), [at, *ends[:-1].tolist()], ends.tolist()

    def _joined(self, spans) -> bytes | None:
        """The tokens of overlapping spans (first place, ids), joined at common ones; None where two have none in common."""
        out, skip, last = [], 0, None
        for at, ids in spans:
            now = self._tokens(at, ids)
            if last is not None:
                places = {start: (end, i) for i, (start, end) in enumerate(zip(last[1], last[2])) if start >= at}
                common = next(((places[s][1], j) for j, (s, e) in enumerate(zip(now[1], now[2])) if places.get(s, (None,))[0] == e), None)
                if common is None:
                    return None
                out += last[0][skip : common[0]]
                skip = common[1]
            last = now
        return np.array(out + last[0][skip:], dtype="<u4").tobytes()

    def _following(self, raw: bytes):
        """Spans that each begin at the first token of the one before in its second half; equal ones are encoded once."""
        known, at = {}, 0
        while True:
            span = raw[at : at + FOLLOWING]
            if span not in known:
                if len(known) == PIECES:
                    known.clear()
                known |= self._encode([span])
            yield at, known[span]
            if at + FOLLOWING >= len(raw):
                return
            at = next(s for s in self._tokens(at, known[span])[1] if s >= at + FOLLOWING // 2)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        places = {b: range(0, len(b) - SPAN // 2, SPAN // 2) for b in raw if len(b) > LONG}
        parts = dict.fromkeys(b for b in raw if len(b) <= LONG)
        for b, starts in places.items():
            parts.update(dict.fromkeys(b[i : i + SPAN] for i in starts))
        ids = self._encode(list(parts))
        for b, starts in places.items():
            joined = self._joined((i, ids[b[i : i + SPAN]]) for i in starts)
            joined = self._joined(self._following(b)) if joined is None else joined
            ids[b] = self._encode([b])[b] if joined is None else joined
        self.known.new.update(zip(pieces, map(ids.__getitem__, raw)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        with worker.no_collection():
            self.known.age()
            known, cut = self.known.new, [self.pattern.findall(t) for t in texts]
            found = [list(map(known.get, pieces)) for pieces in cut]
            new = self.known.missing(p for pieces, ids in zip(cut, found) if None in ids for p, x in zip(pieces, ids) if x is None)
            self._learn(new)
            out = [b"".join([known[p] if x is None else x for p, x in zip(pieces, ids)] if None in ids else ids) for pieces, ids in zip(cut, found)]
            for p in new:
                if len(p) > _SHORT:
                    del known[p]
        return out

    def decode(self, ids: list[bytes]) -> Iterator[bytes]:
        """The bytes that each list of ids stands for."""
        group, held = [], 0
        for x in [*ids, None]:
            if group and (x is None or held + len(x) // 4 > _DECODED):
                yield from self._decode(group)
                group, held = [], 0
            if x is not None:
                group.append(x)
                held += len(x) // 4

    def _decode(self, group: list[bytes]) -> list[bytes]:
        tok = np.frombuffer(b"".join(group), dtype="<u4").astype(np.int32)
        ids = pa.table({"doc": np.repeat(np.arange(len(group), dtype=np.int32), [len(x) // 4 for x in group]), "pos": np.arange(len(tok), dtype=np.int32), "id": tok})  # noqa: F841
        found = self.db.execute("SELECT doc, string_agg(piece, '' ORDER BY pos) AS t, count(*) AS n FROM ids JOIN vocabulary USING (id) GROUP BY doc").fetchall()
        out, known = [b""] * len(group), 0
        for doc, text, n in found:
            known += n
            out[doc] = np.frombuffer(text.encode("utf-16-le"), dtype="<u2").astype(np.uint8).tobytes()
        if known != len(tok):
            raise ValueError("ids beyond the vocabulary")
        return out


def _maker(spark: SparkSession, path: str, pattern: str):
    """What gives a worker's tokenizer, made once a process for the same ranks and pattern."""
    bounded_batches(spark)
    ranks = read_ranks(path)
    # a vocabulary: of fixed size, read on the driver so that executors need not have the file
    shared, key = spark.sparkContext.broadcast(ranks), ("bpe", pattern, hashlib.sha256(repr(ranks).encode()).hexdigest())
    return lambda: worker.keep(key, lambda: Bpe(shared.value, pattern))


def _small(batch: pa.RecordBatch, most: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every whole text.

    Takes doc_id and text; other columns are not read. A null or empty text has no tokens. A row per input row, also
    for repeated rows; an empty table gives none. path is a rank file, pattern what cuts texts before merging.
    """
    make = _maker(docs.sparkSession, path, pattern)

    def run(batches):
        bpe = make()
        for batch in batches:
            for b in _small(batch):
                ids = bpe.encode([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    docs = tidy(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of encode() with decoded: the bytes that ids stand for (null ids: none)."""
    make = _maker(encoded.sparkSession, path, pattern)

    def run(batches):
        bpe = make()
        for batch in batches:
            for b in _small(batch):
                out = list(bpe.decode([x or b"" for x in b.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    encoded = tidy(encoded, "doc_id", "n_tokens", "ids")
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")
