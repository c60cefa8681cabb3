"""Near-duplicates of documents and vectors, archives: brute force and odd rows."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import common, embed, files, minhash, warc

SF = "/root/testdata/sf0.001"


def shingles(t, size=5):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def smallest(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            a = min(root[i], root[j])
            if (root[i], root[j]) != (a, a):
                root[i] = root[j] = a
                changed = True
    return root


def variants():
    """Bases, exact copies, copies at similarities round the threshold, chains and texts that share a passage."""
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    passage, out = [word() for _ in range(60)], []
    for _ in range(12):
        base = [word() for _ in range(random.choice((6, 40, 120, 400)))]
        out.append(base)
        for edits in (0, 1, 2, 3, 6):
            near = list(base)
            for _ in range(edits):
                near[random.randrange(len(near))] = word()
            out.append(near)
        out += [base + passage, passage + base]
    return [" ".join(x) for x in out]


ODD = [None, "", " \n", "one", "ONE", "one two", "one  two\t", "a b c d e", "A b C d e", "é b c d e", "É b c d e", "x " * 30_000, "x " * 40_000]


@pytest.mark.parametrize(("tile", "most"), [(50, 36), (minhash.TILE, 36), (300, 0)])
def test_documents_against_all_pairs(spark, monkeypatch, tile, most):
    monkeypatch.setattr(minhash, "MOST_TILES", most)
    texts = ODD + variants()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rep long").repartition(5)
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = smallest(len(texts), linked)
    found = sorted(minhash.near_duplicates(docs, tile=tile).collect(), key=lambda r: r["doc_id"])
    assert [r["n_shingles"] for r in found] == [len(s) for s in sets]
    assert [r["component_id"] for r in found] == want
    assert [r["kept"] for r in found] == [i == w for i, w in enumerate(want)]
    kept = minhash.keep(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, w in enumerate(want) if i == w]


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    found = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert sorted(str(r["doc_id"]) for r in minhash.keep(docs).collect()) == ["1", "3", "None"]
    assert minhash.near_duplicates(docs.where("false")).count() == 0 and minhash.keep(docs.where("false")).count() == 0


def test_signatures_meet_by_pigeonhole():
    """Any two signatures within the guaranteed distance share a key."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    values = minhash.CHUNKS * minhash.WIDTH
    most = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, values).astype(np.uint16)
        b = a.copy()
        b[rng.choice(values, most, replace=False)] += 1
        batch = pa.RecordBatch.from_pydict({"rep": pa.array([1, 2], pa.int64()), "sig": [a.tobytes(), b.tobytes()]})
        keys = next(iter(minhash._keys([batch])))
        one, two = (set(keys.filter(pa.compute.equal(keys["rep"], i))["key"].to_pylist()) for i in (1, 2))
        assert one & two


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(random.randrange(300, 500), random.randrange(300, 500)) for _ in range(120)] + [(9, 9)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    place = {x: i for i, x in enumerate(nodes)}
    want = smallest(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    found = {r["node"]: r["component_id"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: nodes[w] for x, w in zip(nodes, want)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [0, 100])
def test_sized_join(spark, limit):
    left = spark.createDataFrame([(i, "h" if i % 3 else None) for i in range(60)], "id long, k string")
    right = common.cut(spark.createDataFrame([("h", 1), (None, 2), ("z", 3)], "k string, v int"))
    for salt in (None, "id"):
        rows = common.join_sized(left, right, "k", limit=limit, salt=salt).collect()
        assert sorted((r["id"], r["v"]) for r in rows) == [(i, 1 if i % 3 else 2) for i in range(60)]


def brute(vectors, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    pairs = []
    for i in range(len(vectors)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], dtype=float), np.array(vectors[j], dtype=float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    pairs.append((i, j))
    return pairs


@pytest.mark.parametrize(("kind", "tile"), [("float", 10_000), ("float", 20), ("double", 40), ("double", 7)])
def test_vectors_against_all_pairs(spark, kind, tile):
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((25, 16))
    vectors = [(c + rng.standard_normal(16) * s).astype(np.float32).tolist() for c in centers for s in (0, 0, 0.05, 0.2, 0.35, 0.45, 1)]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1e-30] * 16, [2e-30] * 16, [1.0, 2.0], [2.0, 4.1], [1.0], [-1.0], [3.0]]
    vectors += [(centers[0] + rng.standard_normal(16) * 0.02).astype(np.float32).tolist() for _ in range(90)]
    frame = spark.createDataFrame([(i, v, 0, 5) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, label int, n_links int").repartition(4)
    pairs = brute(vectors)
    want, n = smallest(len(vectors), pairs), np.bincount([x for p in pairs for x in p], minlength=len(vectors))
    found = sorted(embed.near_duplicates(frame, tile=tile).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in found] == n.tolist()
    assert [r["component_id"] for r in found] == want and [r["kept"] for r in found] == [i == w for i, w in enumerate(want)]


def test_vector_rows_without_links(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    found = sorted((tuple(r) for r in embed.near_duplicates(frame).collect()), key=str)
    assert found == sorted([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)], key=str)
    for none in (frame.where("false"), frame.where("vec_id is null")):
        assert embed.near_duplicates(none).where("n_links > 0").count() == 0


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nx", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "long " * 60_000), (7, "u", "<p>x</p>"), (None, "u", "n"), (8, "u", "n"), (7, "u", "<p>x</p>")]


def pages_frame(spark):
    return spark.createDataFrame([(*p, "q") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)


def test_archive_round_trip(spark):
    found = warc.archive(pages_frame(spark)).withColumn("page", warc.page_id("record_id")).withColumn("first", warc.page_id("refers_to")).collect()
    keep = {}
    for page, _, html in PAGES:
        keep[html or ""] = max(keep.get(html or "", -1), -1 if page is None else page)
    want = []
    for page, _, html in PAGES:
        raw, revisit = (html or "").encode(), page is not None and page < keep[html or ""]
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keep[html or ""] if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["first"])) for r in found)


def test_archive_payloads_and_pushed_predicates(spark):
    path = common.new_dir(spark, "w")
    warc.write(warc.page_records(pages_frame(spark), min_bytes=5), path)
    all_ = warc.read(spark, path)
    texts = {r["record_id"]: bytes(r["payload"]).decode() for r in all_.where("record_type = 'response'").collect()}
    assert texts["urn:page:5"] == PAGES[4][2] and texts["urn:page:6"] == PAGES[5][2] and texts["urn:page:3"] == ""
    assert {r["record_id"] for r in all_.where("record_type = 'revisit'").collect()} == {"urn:page:1", "urn:page:2"}
    assert all_.where("record_type in ('response', 'revisit') and target_uri like 'http://b%'").count() == 1
    plan = all_.where("record_type = 'revisit' and refers_to is not null")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert warc.read(spark, path).where("record_type = 'warcinfo'").count() >= 1


def test_uncommitted_files_are_not_read(spark):
    path = common.new_dir(spark, "w")
    warc.write(warc.page_records(pages_frame(spark)), path)
    n = warc.read(spark, path).count()
    stream, _ = files.create(path, "part", ".warc.gz")
    stream.write(b"half a record")
    stream.close()
    assert warc.read(spark, path).count() == n
    empty = common.new_dir(spark, "w")
    warc.write(warc.page_records(pages_frame(spark).where("false")), empty)
    assert warc.read(spark, empty).count() == 0


def test_foreign_archives(spark, tmp_path):
    """Plain files, members without lengths, and records that are not HTTP."""
    row = {"record_id": "urn:x", "record_type": "response", "target_uri": "http://x/", "date": "2020-01-01T00:00:00Z", "payload_digest": warc.digest(b"abc"), "payload_bytes": 3, "refers_to": None, "payload": b"abc"}
    other = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:m>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(warc.record(row) + other + warc.record(row))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.record(row)) + gzip.compress(other) + warc.member(warc.record(row)))
    found = warc.read(spark, str(tmp_path), verify=True).collect()
    assert len(found) == 6 and sum(bytes(r["payload"]) == b"abc" for r in found) == 4
    assert warc.read(spark, str(tmp_path), payload=False).where("record_type = 'metadata'").count() == 2
    row["payload_digest"] = warc.digest(b"abd")
    (tmp_path / "c.warc").write_bytes(warc.record(row))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, str(tmp_path), verify=True).collect()


def test_base32(spark):
    for p in (b"", b"abc", bytes(range(256))):
        got = spark.range(1).select(warc._base32(F.sha1(F.lit(bytearray(p)))).alias("d")).first()["d"]
        assert got == warc.digest(p)
