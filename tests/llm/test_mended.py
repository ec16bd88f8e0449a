"""Cases that once went wrong: caps, lost rows, broken media, two writers, misleading names."""

import collections
import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archweave.llm import media, mixing, neardup, pieces, quality, sitetree, tokencounts, topk
from archweave.llm.common import LEAST_HOT, ship, turn


def test_any_altered_gif_is_frames_or_an_error(spark):
    rng, good = random.Random(4), media.encode(bytes(range(64)) * 3)
    rows = [(i, bytearray(good[:cut])) for i, cut in enumerate(range(0, len(good), 37))]
    for i in range(120):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(bad)) if i % 2 else rng.choice([6, 7, 8, 9, 10, len(good) - 4, 781, 790, 799, 800])
            bad[min(at, len(bad) - 1)] = rng.randrange(256)
        rows.append((1000 + i, bad))
    huge = bytearray(good)
    huge[6:10] = b"\xff\xff\xff\xff"
    at = good.index(b"\x08", 13 + 768 + 8)
    rows += [(2000, huge)] + [(2001 + n, bytearray(good[:at] + bytes([n]) + good[at + 1 :])) for n in (0, 1, 9, 255)]
    got = collections.Counter(r["id"] for r in media.gif_frames(ship(spark).createDataFrame(rows, "media_id long, media binary")).select("id", "error").filter("error IS NOT NULL").collect())
    assert {2000, 2001, 2002, 2010, 2256} <= set(got) and set(got.values()) == {1}


def test_topk_takes_any_finite_component(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e15, 1.0]), (2, [1.0, 1e15]), (3, [-1e30, 1.0]), (20, [2.0**60, 3.0]), (21, [2.0**60, 5.0]), (22, [1e308, 1e308]), (23, [0.5, None])]
    got = collections.defaultdict(list)
    for r in topk.search(ship(spark).createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows[:6]}
    for q in (0, 20):
        clamp = lambda z: max(-(2**63), min(2**63 - 1, z))
        want = sorted(((clamp(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))
        assert got[q] == [(i, s) for s, i in want]


def test_two_writers_and_compaction(spark, tmp_path):
    made, kind = {"words_v1": tokencounts.words_v1}, "sign int, source string, lang string, text string"
    roll = tokencounts.Rollup(ship(spark), f"file://{tmp_path}/roll", made)
    one = spark.createDataFrame([(1, "a", "en", "one two")], kind)
    total = lambda r: [tuple(x)[3:] for x in r.totals().collect()]
    # the second writer comes when the first is past its look at what is in place
    late = tokencounts.Rollup(spark, f"file://{tmp_path}/roll", made)
    late.batches = lambda: []
    assert roll.commit("x", one) and not late.commit("x", one) and total(roll) == [(1, 2)] and roll.batches() == ["x"]
    for name in "yz":
        assert roll.commit(name, one)
        assert roll.compact() and not roll.commit(name, one) and roll.batches() == sorted("x" + "yz"[: "yz".index(name) + 1])
    assert total(roll) == [(3, 6)] and roll._names("deltas", "batch=") == ["z"]
    assert roll.commit("w", spark.createDataFrame([(-1, "a", "en", "one two")], kind)) and total(roll) == [(2, 4)]


def test_one_row_of_each_group_whatever_its_id(spark):
    long = lambda s: " ".join(f"{s}{i}" for i in range(60))
    a, b, near = long("a"), long("b"), long("a") + " more"
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (7, a, 1), (3, a, 1), (None, b, 1), (None, long("c"), 1), (9, near, 1), (9, None, 1), (8, "", 1), (8, "", 1)]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string, at int").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == sorted([("3", a), ("5", b), ("None", long("c"))])
    assert sum(not r["text"] for r in kept.collect()) == 3 and neardup.keep_one(df.limit(0)).count() == 0


def test_a_hot_bucket_lies_in_several_places(spark):
    """Near copies in larger numbers than one task takes: one component, with every row told."""
    base = [f"w{i}" for i in range(80)]
    n = LEAST_HOT + 300
    rows = [(i, " ".join([*base, f"e{i}"])) for i in range(n)] + [(n + i, f"alone {i} " * 3) for i in range(5)]
    out = neardup.near_duplicates(ship(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and {r["component_id"] for r in out if r["doc_id"] < n} == {0} and sum(r["kept"] for r in out) == 6


def test_short_junk_is_judged():
    votes = lambda t: quality.votes(quality.Traits(t))
    assert -1 in votes("x" * 50_000) and -1 in votes("That*** atly.###") and -1 not in votes("This.") and -1 not in votes("OK GO")
    assert quality.shape("abcdef#1#abcdef#2#x") == quality.shape("abcdxx#1#zzbcdef#2#x") != quality.shape("abcdef#1#abcdef#2#")


def test_sample_is_bounded_under_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 10)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, prior: (seen.append(len(rows)), (np.zeros(quality.DIM), 0.0))[1])
    quality.train(ship(spark).createDataFrame([(1, f"text {i % 40}") for i in range(400)], "doc_id long, text string"))
    assert seen == [10]


def test_blocks_are_equal(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(500)] + [(None, "a")] * 40
    out = mixing.mix(ship(spark).createDataFrame(rows, "doc_id long, source string"), block_docs=16, period=50).collect()
    sizes = collections.Counter((r["mix_source"], r["mix_block"]) for r in out)
    for s in "ab":
        own = [n for (x, _), n in sorted(sizes.items()) if x == s]
        assert set(own[:-1]) == {16} and 0 < own[-1] <= 16
    named = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, s in rows if s == "b")
    assert [r["mix_block"] for r in sorted((r for r in out if r["mix_source"] == "b"), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest())] == [i // 16 for i in range(len(named))]


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'aria-hidden="false"', 'data-class="nav"', "class='social-science'", 'class="no-banner"', "title='class=nav'"])
def test_names_inside_other_attributes_say_nothing(attrs):
    assert list(sitetree.texts(sitetree.parse(f"<div {attrs}><p>kept</p></div>"))) == ["kept"]


def test_importance_by_recursion(spark):
    """The sums over ancestors against the recursion that they stand for, on a host of its own."""
    pages = [f"<body><div class=x><ul><li>Menu<li>{'Home' if i % 2 else 'Away'}</ul></div><section><p>text {i}<p>again</p>{'<h2>t</h2>' if i % 3 else ''}</section>tail</body>" for i in range(24)]
    df = ship(spark).createDataFrame([("h", p) for p in pages], "host string, html string")
    got = {bytes(r["chain"]): (r["composite"], r["best"]) for r in sitetree.importance(df).collect()}
    styles, kids, texts, present = (collections.defaultdict(collections.Counter) for _ in range(4))
    for p in pages:
        found, shares = sitetree.observed(sitetree.parse(p))
        for chain, kind, seen in found:
            (styles if kind == sitetree.STYLE else texts)[chain][seen] += 1
        for chain, share in shares.items():
            kids[chain[:-8]][chain] += share
            present[chain][0] += 1

    def composite(chain):
        if chain in texts:
            m = math.log(present[chain][0] + sitetree.SPARE)
            return 1 - sum(math.log(c) / m for c in texts[chain].values()) / len(texts[chain])
        n = sum(styles[chain].values())
        varied = 1 - sum(c * math.log(c) for c in styles[chain].values()) / (n * math.log(n + sitetree.SPARE))
        damp = sitetree.DAMPING ** len(styles[chain])
        return (1 - damp) * sum(share / n * composite(k) for k, share in kids[chain].items()) + damp * varied

    below = lambda chain: [c for c in present if c.startswith(chain)]
    assert set(got) == set(present)
    for chain in present:
        assert got[chain] == pytest.approx((composite(chain), max(map(composite, below(chain)))))


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (2000, 16_000):
        began = time.perf_counter()
        sitetree.observed(sitetree.parse("<div>a" * n))
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def test_a_worker_keeps_one_stage_in_memory():
    """What encoding remembers of chunks went on filling the worker while near-dedup ran in it."""
    proto = Path(pieces.MODEL).read_bytes()
    pieces.codec(proto, 1, 0.1).packed_many(["some words"], [0], [1])
    turn("archweave.llm.pieces")
    assert pieces.codec.cache_info().currsize == 1
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "tag": [2], "text": ["some words of a text"]})
    assert sum(b.num_rows for b in neardup.fingerprints(3)(iter([batch]))) == 1
    assert pieces.codec.cache_info().currsize == 0


def test_places_that_memory_does_not_hold_are_merged_together(monkeypatch):
    """Each such place was merged alone; together they give the ids of the plain agenda, whatever the length and the signs."""
    proto = Path(pieces.MODEL).read_bytes()
    rng = random.Random(3)
    words = ["".join(rng.choice("aaeeinorstlmcd,.ß한é9") for _ in range(rng.randint(1, pieces.SHORT - 1))) for _ in range(400)]
    texts = ["international cooperation of the committees, " * 3 + " ".join(words), "", None, "  two  spaces ▁ and\ttabs\n", " ".join(words[:50]), "x"]
    for rate in (0.0, 0.1, 0.5):
        own = pieces.Codec(proto, rate=rate)
        own.room = 0
        keys = np.array([rng.getrandbits(64) for _ in words], np.uint64)
        assert own._many(words, keys) == [own._chunk(w, int(k)) for w, k in zip(words, keys, strict=True)]
        held = pieces.Codec(proto, rate=rate)
        want = held.packed_many(texts, [0] * 6, list(range(6)))
        monkeypatch.setattr(pieces, "AT_ONCE", 7)
        assert own.packed_many(texts, [0] * 6, list(range(6))) == want
        monkeypatch.undo()
    alone = []
    plain = pieces.Codec(proto)
    plain.room = 0
    short = plain._short
    monkeypatch.setattr(plain, "_short", lambda *a: alone.append(a) or short(*a))
    plain.packed_many(["some words that nobody holds"] * 9, [0] * 9, list(range(9)))
    assert not alone
