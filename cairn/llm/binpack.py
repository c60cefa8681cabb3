"""Token ids in files of fixed-width bit fields.

A file holds: MAGIC; the ids, each in the least bits that hold every id of the vocabulary, in blocks of BLOCK ids that
start at whole bytes; the blocks' byte offsets and each document's id and number of ids as arrays; a footer that says
where these begin. Any range of ids is read by seeking to its blocks and unpacking them with numpy. Files come in
ascending doc_id order: documents are dealt by ranges of doc_id, a task sorts its range and writes one file. A file's
name is new in every attempt, and only files that a finished task reports are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from cairn.llm import files, worker
from cairn.llm.common import bounded_batches

MAGIC = b"BITIDS02"
BLOCK = 8192
#: bits, ids in a block, documents, documents without an id (the first ones), ids; offsets of the block table and the document table
_FOOTER = struct.Struct("<IIQQQQQ8s")
#: Words, and pieces of words, whose ids a Python worker remembers.
_REMEMBERED = 800_000
#: Letters beyond ASCII that composing leaves as they are, and words of these and of printable ASCII.
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
_SIMPLE = re.compile(f"[!-~{_LATIN}]+").fullmatch
_BYTE_LEVEL = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
#: Stands between words that are encoded together; a piece and an id of its own.
_SEPARATOR = "\0"
#: Ids that a reading task returns in one batch, about.
_BATCH_IDS = 1_000_000


def width(vocabulary: int) -> int:
    """Bits that hold every id below the vocabulary's size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian fields of `bits` bits."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(fields.reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n fields of pack()."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    fields = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = fields
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes one file; documents are added in order, those without an id first."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.held, self.n_held, self.n_null = [], 0, 0
        self.offsets, self.docs, self.counts = [], [], []
        self.at = stream.write(MAGIC) or len(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Some documents' ids one after another, and how many each has."""
        self.n_null += doc_ids.null_count
        self.docs.append(doc_ids.fill_null(0).to_numpy().astype("<i8"))
        self.counts.append(counts.astype("<u4"))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, dtype="<u4")
        for i in range(0, n, self.block):
            raw = pack(flat[i : min(i + self.block, n)], self.bits)
            self.offsets.append(self.at)
            self.stream.write(raw)
            self.at += len(raw)
        self.held, self.n_held = [flat[n:]], len(flat) - n

    def close(self) -> tuple[int, int]:
        """Ends the file; its numbers of documents and ids."""
        self._flush(self.n_held)
        blocks = self.at
        self.stream.write(np.array(self.offsets, dtype="<u8").tobytes())
        docs = blocks + 8 * len(self.offsets)
        ids, counts = np.concatenate([np.empty(0, dtype="<i8"), *self.docs]), np.concatenate([np.empty(0, dtype="<u4"), *self.counts])
        self.stream.write(ids.tobytes() + counts.tobytes())
        n = int(counts.sum(dtype=np.int64))
        self.stream.write(_FOOTER.pack(self.bits, self.block, len(ids), self.n_null, n, blocks, docs, MAGIC))
        self.stream.close()
        return len(ids), n


class Reader:
    """Random access to one file."""

    def __init__(self, f):
        self.f, size = f, f.size()
        self.bits, self.block, n_docs, self.n_null, self.n_ids, blocks, docs, magic = _FOOTER.unpack(self._bytes(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        self.offsets = np.frombuffer(self._bytes(blocks, docs - blocks), dtype="<u8")
        self.end = blocks
        self.doc_ids = np.frombuffer(self._bytes(docs, 8 * n_docs), dtype="<i8")
        self.counts = np.frombuffer(self._bytes(docs + 8 * n_docs, 4 * n_docs), dtype="<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _bytes(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file; only their blocks are read."""
        if start >= end:
            return np.empty(0, dtype="<u4")
        first, last = start // self.block, (end - 1) // self.block
        at = int(self.offsets[first])
        raw = self._bytes(at, (int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end) - at)
        n, step = min((last + 1) * self.block, self.n_ids) - first * self.block, (self.block * self.bits + 7) // 8
        if self.block * self.bits % 8 == 0:
            flat = unpack(raw, n, self.bits)
        else:  # blocks begin at whole bytes
            flat = np.concatenate([unpack(raw[i * step : (i + 1) * step], min(self.block, n - i * self.block), self.bits) for i in range(last - first + 1)])
        return flat[start - first * self.block : end - first * self.block]


class WordEncoder:
    """Encodes texts with a tokenizers file; strings of its added tokens become these, as in the library.

    With by_word, texts are cut at ASCII white space and a batch's distinct words are looked up once; a text's ids are
    gathered from its words'. That is exact for tokenizers that drop white space and never look across it. Where the
    file's steps are those that _plain() names, new words of printable ASCII and Latin-1 letters, which its normaliser
    only lower-cases, are cut by its own pattern and their pieces go straight to its model, each once. All other new
    words go through the whole tokenizer as they are, many in one text, between separators: a normaliser may compose a
    capital with a mark before it drops case (H with a line below has no precomposed form, h has).
    """

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        if by_word:
            self.known, self.pieces = worker.Recent(_REMEMBERED), worker.Recent(_REMEMBERED)
            self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            (self.separator,) = np.frombuffer(self._ids([_SEPARATOR])[0], dtype="<u4")
            self.pattern = _plain(json.loads(self.tokenizer.to_str()))
            self.model = self.tokenizer.model
            # how a byte-level model writes the bytes of letters beyond ASCII
            self.written = {ord(c): _BYTE_LEVEL.pre_tokenize_str(c)[0][0] for c in _LATIN}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, pieces: list[str]) -> None:
        tokenize, written = self.model.tokenize, self.written
        for p in pieces:
            self.pieces.new[p] = array("I", [t.id for t in tokenize(p if p.isascii() else p.translate(written))]).tobytes()

    def _learn(self, words: list[str]) -> None:
        simple, rest, single, added = [], [], [], self.added
        for w in words:
            if _SEPARATOR in w or ("<" in w and any(t in w for t in added)):
                single.append(w)
            elif self.pattern is not None and _SIMPLE(w):
                simple.append(w)
            else:
                rest.append(w)
        cut = list(map(self.pattern, map(str.lower, simple))) if simple else []
        self._learn_pieces(self.pieces.missing(chain.from_iterable(cut)))
        known, piece = self.known.new, self.pieces.new.__getitem__
        for w, p in zip(simple, cut):
            known[w] = piece(p[0]) if len(p) == 1 else b"".join(map(piece, p))
        if single:
            known.update(zip(single, self._ids(single)))
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            raw = self._ids([f" {_SEPARATOR} ".join(some)])[0]
            at = 4 * np.flatnonzero(np.frombuffer(raw, dtype="<u4") == self.separator)
            known.update((w, raw[s:e]) for w, s, e in zip(some, [0, *(at + 4).tolist()], [*at.tolist(), len(raw)], strict=True))

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another, each text's ended with `end` if given, and their numbers."""
        with worker.no_collection():
            return self._flat(texts, end)

    def _flat(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        last = [] if end is None else [np.array([end], dtype="<u4").tobytes()]
        if not self.by_word:
            ids = [b"".join([x, *last]) for x in self._ids([t or "" for t in texts.to_pylist()])]
            return np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(x) // 4 for x in ids], dtype=np.int64)
        cut = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = cut.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        self.known.age()
        self.pieces.age()
        self._learn(self.known.missing(words))
        ids = [*map(self.known.new.__getitem__, words), *last]
        ends = cut.offsets.to_numpy().astype(np.int64)
        ends = ends[1:] - ends[0]
        if last:
            codes = np.insert(codes, ends, len(words))
            ends += np.arange(1, len(ends) + 1)
        table = b"".join(ids)
        kind = np.int32 if len(table) < 1 << 31 else np.int64
        lengths = np.fromiter(map(len, ids), dtype=kind, count=len(ids)) >> 2
        starts = np.cumsum(lengths, dtype=kind) - lengths
        n = lengths[codes]
        upto = np.cumsum(n, dtype=np.int64)
        # runs of places in the table: one more each time, but for the jump where a word ends and the next begins
        places = np.ones(int(upto[-1]) if len(upto) else 0, dtype=kind)
        some = np.flatnonzero(n)
        if len(some):
            first = starts[codes[some]]
            jump = first - np.concatenate([[0], first[:-1] + n[some[:-1]] - 1])
            places[upto[some] - n[some]] = jump
            np.cumsum(places, out=places)
        counts = np.diff(np.concatenate([[0], upto])[ends], prepend=0)
        return np.frombuffer(table, dtype="<u4")[places], counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        ids, counts = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def _plain(spec: dict):
    """What finds the pieces of a lower-cased simple word, from a tokenizers file's description; None if its steps are others.

    They must be: compose, shrink white space, lower-case; keep the pattern's matches; write bytes as letters. In simple
    words, the pattern's letters and digits are those below, in every version of Unicode.
    """
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return None
    split, level = cuts
    if "Regex" not in split["pattern"] or (split["behavior"], split["invert"]) != ("Removed", True) or level["add_prefix_space"] or level["use_regex"]:
        return None
    pattern = split["pattern"]["Regex"].replace(r"\p{L}", f"a-z{_LATIN.lower()}").replace(r"\p{N}", "0-9")
    return None if r"\p" in pattern else re.compile(pattern).findall


def _encoder(path: str, by_word: bool) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return worker.keep(("words", path, by_word), lambda: WordEncoder(path, by_word))


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int, by_word: bool = False) -> list[tuple[str, int, int, int]]:
    """Encodes whole texts, ends each document with end_id and writes files of packed ids below folder.

    Takes doc_id (null first; rows that share one stand in the order in which they are read, and may go to several
    files) and text (null: empty); other columns are not read. Returns the files in ascending doc_id order: (path,
    start, documents, ids), start being the ids of all files before; a row a file. An empty table gives no files.
    """
    bounded_batches(docs.sparkSession)
    bits = width(vocabulary)

    def run(batches):
        encoder = _encoder(tokenizer, by_word)
        writer = path = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                stream, path = files.create(folder, f"part-{TaskContext.get().partitionId():06d}", ".ids")
                writer = Writer(stream, bits)
            writer.add(batch.column(0), *encoder.flat(batch.column(1), end_id))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    out, start = [], 0
    for row in sorted(rows.mapInArrow(run, "part long, path string, n_docs long, n_ids long").collect()):
        out.append((row["path"], start, row["n_docs"], row["n_ids"]))
        start += row["n_ids"]
    return out


def read(spark: SparkSession, listed: list[tuple[str, int, int, int]]) -> DataFrame:
    """The documents of listed files: doc_id, start (ids of all documents before), n_tokens, ids (binary, little-endian 32-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input(path) as f:
                    r, first = Reader(f), 0
                    none = np.arange(len(r.counts)) < r.n_null
                    while first < len(r.counts):
                        last = max(first + 1, int(np.searchsorted(r.starts, r.starts[first] + _BATCH_IDS, side="right")) - 1)
                        last = min(last, len(r.counts))
                        flat, at = r.ids(int(r.starts[first]), int(r.starts[last])).tobytes(), (r.starts[first : last + 1] - r.starts[first]) * 4
                        ids = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                        own = pa.array(r.doc_ids[first:last], pa.int64(), mask=none[first:last])
                        yield pa.RecordBatch.from_arrays([own, pa.array(before + r.starts[first:last], pa.int64()), pa.array(r.counts[first:last], pa.int64()), pa.array(ids, pa.binary())], schema=schema)
                        first = last

    paths = spark.createDataFrame(listed, "path string, start long, n_docs long, n_ids long").select("path", "start")
    return paths.repartition(max(1, len(listed))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
