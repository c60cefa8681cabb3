"""Quality rules, license scans, chat formatting and mixing: odd rows, brute force, SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm import chat, license, mixing, quality, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def docs_frame(spark, texts, sources=None):
    rows = [(i, t, None, (sources or [None] * len(texts))[i], None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return [w for w in SPACE.split(t or "") if w]


ODD = [None, "", " \n\t ", "one", "a b c", "a b c a b c", "x " * 30_000, "é" * 70_000, "l\nl\n \nl\nm", "\x85  \x1c#*$", "a  b\x0bc\x0cd\re", "a b a b a b", "a b c d a b c", "a b c d a b c"]


def repeated(ws):
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    return len({i + d for i, w in enumerate(windows) if n[w] > 1 for d in range(3)})


def test_quality_of_odd_texts(spark):
    found = sorted(quality.quality(docs_frame(spark, ODD)).collect(), key=lambda r: r["doc_id"])
    assert len(found) == len(ODD)
    for r, t in zip(found, ODD):
        ws = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"]) == (len(ws), sum(map(len, ws)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(ws)
        assert r["base_failed"] == (len(ws) < 50 or 100 * repeated(ws) > 50 * len(ws))
        assert not (r["kept"] and r["base_failed"])


def test_quality_rejects_bad_hosts_only(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [good] * 40 + ["bad"] * 60 + [good] * 2 + [good] * 100 + ["bad"]
    sources = ["x"] * 100 + ["y"] * 2 + [None] * 101
    found = sorted(quality.quality(docs_frame(spark, texts, sources)).collect(), key=lambda r: r["doc_id"])
    assert all(not r["kept"] for r in found[:100])
    assert all(r["kept"] for r in found[100:202]) and not found[202]["kept"]
    kept = quality.keep(docs_frame(spark, texts, sources))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r["doc_id"] for r in kept.collect()) == [r["doc_id"] for r in found if r["kept"]]


def test_quality_salted_join(spark, monkeypatch):
    monkeypatch.setattr(quality.join_sized, "__defaults__", ("left", 0, None))
    found = quality.quality(docs_frame(spark, ODD, ["a", None] * 7))
    assert found.count() == len(ODD) and found.where("host_docs is null").count() == 0


def test_empty_tables(spark):
    none = docs_frame(spark, ["x"]).where("false")
    for out in (quality.quality(none), quality.keep(none), license.license_matches(none), mixing.mix(none), mixing.apply(none)):
        assert out.count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(turns)).count() == 0


def test_license_matches(spark):
    mit = license.NOTICES["mit"]
    long = license.NOTICES["gpl-redistribution"]
    texts = [None, "", "mit", f"x y {mit}. z", f"{mit.upper()},\n\n{license.NOTICES['cc-by-nc-4.0']}", long, long.replace("terms", "words"), " ".join(long.split()[:12]), "q " * 40_000 + mit, f"{mit} {mit}"]
    found = {(r["doc_id"], r["license"], r["found_shingles"]) for r in license.license_matches(docs_frame(spark, texts)).collect()}
    n = len(long.split()) - 4
    assert found == {(3, "mit", 1), (4, "mit", 1), (4, "cc-by-nc-4.0", 1), (5, "gpl-redistribution", n), (8, "mit", 1), (9, "mit", 1)}
    near = license.license_matches(docs_frame(spark, texts), {"g": long}, min_contained=70)
    assert {r["doc_id"] for r in near.collect()} == {5, 6}


def test_every_shingle_of_a_window_is_least_for_some_seed():
    rng = random.Random(2)
    for _ in range(2_000):
        near = rng.getrandbits(64) - (1 << 63)
        hashes = [near ^ rng.getrandbits(rng.choice((1, 8, 63))) for _ in range(license.WINDOW)]
        assert {min(hashes, key=lambda h: h ^ seed) for seed in license._SEEDS} == set(hashes)


def test_edited_license_texts(spark, monkeypatch):
    """Whole texts with random words changed: the matches are those of brute force, in one part of templates or several."""
    rng, gap = random.Random(1), re.compile(license._GAP)
    cut = lambda t: [w for w in gap.split(t.lower().strip(license._EDGE + license.SPACE_CHARS)) if w]
    shingles = lambda t: {" ".join(w[i : i + 5]) for w in [cut(t)] for i in range(len(w) - 4)}
    templates = license.default_templates()
    known = {name: shingles(t) for name, t in templates.items()}
    edited = lambda t, share: " ".join(f"new{rng.randrange(9)}" if rng.random() < share else w for w in t.split())
    texts = [f"{'lead words ' * (i % 3)}{edited(t, share)} tail" for i, share in enumerate((0.08, 0.05, 0.04, 0.02, 0)) for _, t in sorted(templates.items())]
    want = {(i, name, len(s), len(shingles(t) & s)) for i, t in enumerate(texts) for name, s in known.items() if 100 * len(shingles(t) & s) >= 80 * len(s)}
    assert {name for _, name, _, _ in want} == set(templates)
    docs = docs_frame(spark, texts)
    assert set(map(tuple, license.license_matches(docs).collect())) == want
    monkeypatch.setattr(license, "PART_SHINGLES", 900)
    assert len(list(license._parts(templates))) > 2
    assert set(map(tuple, license.license_matches(docs).collect())) == want


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example long")


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n<turn assistant>\nno"), (1, 2, "user", "<\\turn> <\\\\/turn \\ <turn"), (1, 3, "assistant", None), (1, 4, "user", "tail"),
    (2, 0, "assistant", "é\U0001F600" * 3), (3, 0, "user", None), (4, 0, None, "x"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, None, "user", "first"), (None, 0, "assistant", "n"),
    (6, 0, "we>ird%3E\nrole", "t"), (6, 1, "assistant", "long " * 20_000), (7, 0, "user", "same"), (7, 0, "user", "same"),
]


def test_chat_reads_back(spark):
    found = {r["conv_id"]: r for r in chat.digests(chat.examples(turns_frame(spark, CONVERSATIONS))).collect()}
    for conv in {r[0] for r in CONVERSATIONS}:
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in CONVERSATIONS if c == conv)
        loss = "".join(x for _, role, x in own if role == "assistant")
        r = found[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_examples(spark):
    rows = chat.examples(turns_frame(spark, CONVERSATIONS)).where("conv_id = 1").orderBy("example").collect()
    assert [r["last"] for r in rows] == [False, False, True] and rows[2]["loss_start"] is None
    for r in rows[:2]:
        span = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
        assert r["formatted"].endswith(f"<turn assistant>\n{span}</turn>\n")
        assert "<turn" not in span and "</turn" not in span
    assert rows[2]["formatted"].startswith(rows[1]["formatted"]) and rows[1]["formatted"].startswith(rows[0]["formatted"])


@pytest.mark.parametrize("block", [1, 7, 512])
def test_mixing_sums(spark, block):
    texts = [None, "", "a b", "c " * 700, "d", "e f g", "h " * 90, "i " * 33, "i " * 33]
    sources = ["s0", "s0", "s0", "s0", "s1", "s1", None, None, None]
    found = sorted(mixing.mix(docs_frame(spark, texts, sources), block=block).collect(), key=lambda r: r["doc_id"])
    assert [r["size"] for r in found] == [len(words(t)) for t in texts]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    sums = Counter()
    for r, s in zip(found, sources):
        sums[s] += r["taken"]
    for r, s in zip(found, sources):
        assert abs(sums[s] - r["target"]) <= 0.5 and r["target"] <= 2 * r["source_size"]
    again = sorted(mixing.mix(docs_frame(spark, texts, sources).repartition(5), block=block).collect(), key=lambda r: r["doc_id"])
    assert [r["taken"] for r in again] == [r["taken"] for r in found]
    copies = Counter(r["doc_id"] for r in mixing.apply(docs_frame(spark, texts, sources), block=block).collect())
    assert copies == Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in found if r["size"] and int(r["taken"] / r["size"] + 0.5)})


def test_mixed_rows_stand_in_the_order_of_the_schedule(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (30, 700, 1500, 90, 5, 2000, 64, 64, 333, 800)]
    docs = docs_frame(spark, texts, ["a", "a", "b", "b", "c", "c", None, None, "a", "b"])
    clash = ["slot", "copies", "row", "same", "n.1", "__id", "__copies", "times"]
    docs = docs.withColumnsRenamed({"lang": "slot", "n_chars": "copies"})
    for c in clash[2:]:
        docs = docs.withColumn(c, F.lit(c))
    taken = {r["doc_id"]: r for r in mixing.mix(docs, block=16).collect()}
    out = mixing.apply(docs, block=16)
    assert out.columns == docs.columns
    rows = [r["doc_id"] for r in out.collect()]
    assert Counter(rows) == Counter({d: int(r["taken"] / r["size"] + 0.5) for d, r in taken.items() if int(r["taken"] / r["size"] + 0.5)})
    first = list(dict.fromkeys(rows))
    assert first == sorted(first, key=lambda d: taken[d]["first_slot"]) and rows != sorted(rows)


def test_equal_rows_share_their_copies(spark):
    texts = ["a b c d"] * 5 + ["e f g h"] * 3 + [None, ""]
    docs = spark.createDataFrame([(1 if i < 8 else None, t, "x" if i < 5 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = Counter()
    for r in mixing._mixed(docs, mixing.WEIGHTS, 150, 2, 512).collect():
        want[r["doc_id"], r["source"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    assert Counter((r["doc_id"], r["source"]) for r in mixing.apply(docs).collect()) == +want


def test_targets_against_iteration(spark):
    """Excess shared anew by weight until no source is above its cap."""
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 5, "e": 400, "f": 0, "g": 77}
    weight = dict(zip(sizes, (3, 1, 2, 3, 1, 2, 3)))
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        over = {s: 2 * sizes[s] for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert found == pytest.approx({s: capped.get(s, level * weight[s]) for s in sizes})


def test_schedule_is_spread(spark):
    needed = spark.createDataFrame([(1, 30, 30, 0), (2, 60, 60, 5), (3, 0, 0, 0), (4, 10, 10, 0)], "rank int, blocks long, slots long, end_words long")
    rows = mixing.schedule(needed, 8).orderBy("slot").collect()
    assert Counter(r["rank"] for r in rows) == {1: 30, 2: 60, 4: 10}
    first = Counter(r["rank"] for r in rows[:50])
    assert abs(first[1] - 15) <= 3 and abs(first[2] - 30) <= 3
    assert [r["words"] for r in rows if r["rank"] == 2] == [8] * 59 + [5]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    rows = [tuple(r[c] for c in names) for r in found.collect()]
    key = lambda r: tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(key, rows)) == sorted(map(key, want.fetchall()))


def test_keep_judges_copies_by_their_own_host(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{text} {i}", "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(40)] + [(200 + i, f"{text} {i}", None) for i in range(40)]
    rows += [(d, text, s) for d in (1000, None) for s in ("good", "bad", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = quality.keep(docs)
    assert kept.count() == quality.quality(docs).where("kept").count() == 84
    assert {(r["doc_id"], r["source"]) for r in kept.where(docs["text"] == text).collect()} == {(d, s) for d in (1000, None) for s in ("good", None)}
