"""The training-data operators against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from archweave.llm import media, mixing, neardup, pieces, pii, quality, queries, sitetree, tokencounts, topk, toxicity
from archweave.llm.common import ship, table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [None, "", " ", "a", "a", "one two", LONG, "éß ▁ 🎉", "x" * 50_000, "1" * 50_000, "@" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return table(ship(spark), SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, and columns whose names the operators use themselves."""
    ship(spark)
    rows = [(i, t, None, None if i % 3 else "s", None, 1, 2, "l") for i, t in enumerate(ODD)] + [(None, "nobody's", "en", "s", 1, 1, 2, "l")]
    return spark.createDataFrame(rows, DOC + ", id long, n long, label string")


# 1 media


def test_lzw_round_trip():
    rng = random.Random(1)
    for data in (b"\0" * 64, b"ab" * 40_000, rng.randbytes(70_000), bytes(range(256)) * 300):
        assert media.lzw_decode(media.lzw_encode(data)) == data


def test_gif_rules():
    """Transparency keeps what is below, disposal 2 clears, 3 restores; times add up; a local palette wins; rows interlace."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(samples, w, h, x=0, y=0, disposal=1, delay=5, clear=None, packed=0, own=b""):
        gce = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
        box = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([packed])
        return gce + box + own + b"\x08" + media.blocks(media.lzw_encode(bytes(samples)))

    head = b"GIF89a" + (2).to_bytes(2, "little") + (2).to_bytes(2, "little") + bytes([0x81, 0, 0]) + palette
    gif = head + frame([1, 1, 1, 1], 2, 2) + frame([2, 3], 2, 1, disposal=3, clear=3) + frame([3], 1, 1, x=1, y=1, disposal=2, delay=7) + frame([0], 1, 1, packed=0x80, own=bytes([9, 8, 7, 1, 1, 1])) + b"\x3b"
    shown = list(media.decode(gif))
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert shown[0].pixels.tolist() == [[red, red], [red, red]]
    assert shown[1].pixels.tolist() == [[green, red], [red, red]]
    assert shown[2].pixels.tolist() == [[red, red], [red, blue]]
    assert shown[3].pixels.tolist() == [[[9, 8, 7, 255], red], [red, [0, 0, 0, 0]]]
    assert [(f.start_cs, f.delay_cs) for f in shown] == [(0, 5), (5, 5), (10, 7), (17, 5)]
    tall = b"GIF89a" + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes([0x87, 0, 0]) + media.PALETTE.tobytes()
    tall += frame([0, 4, 2, 6, 1, 3, 5, 7], 1, 8, packed=0x40) + b"\x3b"
    assert next(media.decode(tall)).pixels[:, 0, 0].tolist() == list(range(8))


def test_op1_contract(spark, odd):
    got = {r["doc_id"]: r for r in media.text_media(odd, keep_media=True).collect()}
    assert len(got) == len(ODD) + 1
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        payload = raw + bytes(size - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), size, hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        assert b"".join(f.pixels[: f.box[3], :, 0].tobytes() for f in media.decode(bytes(r["media"]))) == payload
    assert got[3]["feature"] == got[4]["feature"]


def test_gif_frames_and_broken_media(spark):
    good = media.encode(bytes(range(64)) * 600)
    df = ship(spark).createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"GIF89a")), (4, bytearray(good[:-500]))], "media_id long, media binary")
    rows = media.gif_frames(df).collect()
    assert [r["start_cs"] for r in rows if r["id"] == 1] == [0, 4]
    assert sum(sum(r["hist_r"]) for r in rows if r["id"] == 1) == 64 * (512 + 512)  # the second frame's canvas keeps the first's rows
    assert {r["id"] for r in rows if r["error"]} == {2, 3, 4}


# 2 top-k


def test_topk_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40:90] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (920, [], 0), (940, [float("nan")] * 8, 0), (960, [None] * 8, 0), (980, [float("inf")] * 8, 0), (1000, [1.0, 2.0], 0), (1001, [3.0, 2.0], 0), (1100, [0.0] * 8, 0)]
    df = ship(spark).createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(64 * np.array(v, np.float64)).astype(int) for i, v, _ in rows[:300] + rows[-1:]}
    for q in [i for i in whole if i % 20 == 0]:
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
        assert got[q] == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert got[1000] == [(1, 1001, 64 * 64 * 7)]
    assert not {900, 920, 940, 960, 980} & set(got)
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_stops_early():
    """With a clear winner the lists are not read to their ends."""
    x = np.zeros((5000, 4))
    x[:30, 0] = np.arange(1000, 970, -1)
    lists = topk.Lists(np.arange(5000), x)
    read = []
    lists.up = type("Seen", (np.ndarray,), {"__getitem__": lambda s, k: (read.append(k), np.ndarray.__getitem__(s, k))[1]})(lists.up.shape, lists.up.dtype, np.ascontiguousarray(lists.up))
    ids, _ = lists.top(np.array([1.0, 0, 0, 0]), 20, -1)
    assert ids.tolist() == list(range(20)) and len(read) <= 4


# 3 token counts


def test_rollup(spark, tmp_path):
    ship(spark)
    made = {"words_v1": tokencounts.words_v1, "byte_bpe_50k": tokencounts.byte_pairs()}
    roll = tokencounts.Rollup(spark, f"file://{tmp_path}/roll", made)
    assert roll.totals().count() == 0
    kind = "sign int, source string, lang string, text string"
    rows = [(1, "a", "en", "one two"), (1, "a", "en", "one two"), (1, "b", None, None), (1, None, "en", LONG), (1, "c", "de", "x")]
    assert roll.commit("1", spark.createDataFrame(rows, kind))
    assert not roll.commit("1", spark.createDataFrame(rows, kind))
    assert roll.commit("2", spark.createDataFrame([(-1, "a", "en", "one two"), (1, "a", "en", "one two three"), (-1, "c", "de", "x")], kind))
    assert roll.commit("3", spark.createDataFrame([], kind))
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in roll.totals().filter("tokenizer = 'words_v1'").collect()}
    assert got == {("a", "en"): (2, 5), ("b", None): (1, 0), (None, "en"): (1, 30_000)}
    assert roll.batches() == ["1", "2", "3"]
    with pytest.raises(ValueError, match="name"):
        roll.commit("", spark.createDataFrame([], kind))


def test_op3_against_recount(spark, docs):
    count = {"words_v1": tokencounts.words_v1(), "byte_bpe_50k": tokencounts.byte_pairs()()}
    want = collections.Counter()
    for r in docs.collect():
        if re.search("[a-z0-9]@[a-z0-9]", r["text"]):
            continue
        text = re.sub(r"[*#$%&|]{3,}", "", r["text"])
        for k, f in count.items():
            want[r["source"], r["lang"], k, "docs"] += 1
            want[r["source"], r["lang"], k, "tokens"] += f(text)
    got = collections.Counter()
    for r in queries.op3_token_rollup(spark, SF).collect():
        for c in ("docs", "tokens"):
            got[r["source"], r["lang"], r["tokenizer"], c] = r[c]
    assert got == want


# 4 personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_pii_brute_force(spark, docs):
    texts = [
        "a@b.c_d@e.f.g me@x, é🎉 q%w@a-b.co..", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.04 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000000 5 4111111111111111",
        "+1 (234) 555-0199 +1.......... +12+3456789012 +999 999 999 999 999 99", "+1 4111 1111 1111 1111 a@b 9.9.9.9@x.y", "iban GB82 WEST 1234 5698 7654 32 ssn 123-45-6789 and 123-45-6789",
        "x" * 60_000 + "@", "1." * 30_000, "9" * 60_000, "4111111111111111 " * 3000, "a@" + "b." * 20_000 + "c", "+" + "1 " * 20_000, "", None,
    ]
    made = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = made.union(docs.select("doc_id", "text"))
    text = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    got = {r["doc_id"]: r for r in pii.digest(both).collect()}
    assert set(got) == set(text)
    for i, t in text.items():
        base = plain_spans(t)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t[:80]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k + ":") for s in base) for k in PLAIN]
        assert [s for s in r["spans"].split(",") if s and s.split(":")[0] in PLAIN] == base
    assert "iban:5:32" in got[10_005]["spans"] and got[10_005]["spans"].count("ssn:") == 1  # nearby ends at the neighbouring span


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc or +1 (234) 555-0199, card 4111 1111 1111 1111 not 4111 1111 1111 1112", "k"), (2, None, "k"), (3, "plain 12", "k")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {1: "mail <email> or <phone>, card <card> not 4111 1111 1111 1112", 2: None, 3: "plain 12"}
    assert pii.redact(df).columns == df.columns


def test_iban_ends_where_its_country_says(spark):
    texts = {
        "IBAN DE89370400440532013000 BIC COBADEFFXXX": (5, 27), "GB82 WEST 1234 5698 7654 32 Please": (0, 27), "DE89370400440532013000 2024-01-01": (0, 22), "ref AB12 DE89 3704 0044 0532 0130 00 X1": (9, 36),
        "MT84MALT011000012345MTLCAST001S OK": (0, 31), "NO93 8601 1117 947 NO": (0, 18), "DE89370400440532013001 BIC": None, "DE893704004405320130001": None, "DE89 3704 0044 0532 0130 00\nGB82WEST12345698765432": (0, 27),
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"] if x["kind"] == "iban"] for r in pii.find_spans(df).collect()}
    assert got == {i: [x] if x and i < 8 else [x, (28, 50)] if x else [] for i, x in enumerate(texts.values())}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert masked[0] == "IBAN <iban> BIC COBADEFFXXX" and masked[1] == "<iban> Please" and masked[8] == "<iban>\n<iban>"


def test_redaction_is_of_the_spans(spark):
    """What find_spans keeps is masked and nothing else, with context scores; overlaps become one mask."""
    many = " ".join(f"a{i}@b.cc é🎉 {i}" for i in range(500))
    texts = ["ssn 123-45-6789", "just 123-45-6789 here", "🎉 ssn 123-45-6789 and a@b.cc", "+1 4111 1111 1111 1111 x", "1.2.3.4@x.yy z", many, "", None, "social 123-45-6789 or host 1.2.3.4, DE89370400440532013000 ok"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(df).collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for i, t in enumerate(texts):
        want, done = "", 0
        for x in spans[i]:
            if x["start"] >= done:
                want += t[done : x["start"]] + f"<{x['kind']}>"
            done = max(done, x["end"])
        assert got[i] == (None if t is None else want + t[done:])
    assert got[0] == "ssn <ssn>" and got[1] == texts[1] and got[2] == "🎉 ssn <ssn> and <email>" and got[8] == "social <ssn> or host <ip>, <iban> ok"


# 5 mixing


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1.0 / (i + 1) for i in range(40)}, {"big": 1e9, "tiny": 1e-9}])
def test_pfair_lag(weights):
    shares = mixing.ticks(weights, 500)
    assert all(v >= 1 for v in shares.values())
    seen, period = collections.Counter(), sum(shares.values())
    for s, j, slot, release, due in mixing.schedule(shares):
        assert release <= slot < due and j == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - shares[x] * (slot + 1) / period) < 1 for x in shares)
    assert seen == collections.Counter(shares)


def test_mix_keeps_everything(spark, docs, odd):
    out = mixing.mix(docs, block_docs=4, period=100)
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    slots = collections.defaultdict(set)
    for r in rows:
        slots[r["mix_slot"]].add((r["mix_source"], r["mix_block"]))
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    assert all(len(v) == 1 for v in slots.values())
    clash = odd.withColumn("j", F.lit(1)).withColumn("mix_slot", F.lit("mine")).withColumn("share", F.lit(2))
    again = mixing.mix(clash)
    assert again.count() == odd.count() and dict(again.dtypes)["mix_slot"] == "bigint" and "share" in again.columns
    assert mixing.mix(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        mixing.ticks({"a": 0.0}, 10)


# 6 pieces


@pytest.fixture(scope="module")
def proto():
    return Path(pieces.MODEL).read_bytes()


def test_without_dropout_as_the_library(docs, proto):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Codec(proto, rate=0.0)
    for r in docs.limit(60).collect():
        assert own.encode(r["text"]) == sp.encode(r["text"])


def test_dropout_is_lossless_and_varies(docs, proto):
    own, plain = pieces.Codec(proto, rate=0.3), pieces.Codec(proto, rate=0.0)
    texts = [t or "" for t in ODD] + [r["text"] for r in docs.limit(40).collect()]
    for t in texts:
        assert own.decode(own.encode(t, 1)) == t and own.encode(t, 1) == pieces.Codec(proto, rate=0.3).encode(t, 1)
    t = texts[-1]
    assert len({tuple(x) for x in (own.encode(t, 0), own.encode(t, 1), plain.encode(t, 0))}) == 3
    for w in ["thentherethen" * 3, "aaaa", "▁", "é🎉x"]:
        assert own._short(w, 77) == list(own._long(w, 77))


def test_op6_rows(spark, odd):
    rows = {r["doc_id"]: r for r in pieces.encode_documents(odd).collect()}
    assert all(r["lossless"] for r in rows.values()) and rows[0]["ids"] == [] and rows[0]["n_chars"] == 0
    assert pieces.encode_documents(odd.limit(0)).count() == 0


def test_dropout_is_drawn_at_each_place(proto):
    own, word = pieces.Codec(proto, rate=0.3), " international"
    ids = own.encode(word.strip() + word * 199, 0, 1)
    n = len(own.encode(word.strip(), 0, 1))
    seen, at = set(), 0
    for _ in range(200):
        k = next(k for k in range(1, 20) if own.decode(ids[at : at + k]) == word[1:] or own.decode(ids[at : at + k]) == word.strip())
        seen.add(tuple(ids[at : at + k]))
        at += k
    assert at == len(ids) and len(seen) > 3 and n
    assert len({tuple(own.encode(word * 5, 0, d)) for d in range(50)}) > 10  # documents of one variant differ
    fresh = pieces.Codec(proto, rate=0.3)
    fresh.encode(word * 5, 0, 7)
    assert fresh.encode(word * 5, 0, 3) == own.encode(word * 5, 0, 3) == pieces.Codec(proto, rate=0.3).encode(word * 5, 0, 3)  # memory changes nothing
    full = pieces.Codec(proto, rate=0.3)
    full.room = 0
    assert all(full.encode(word * 9, 0, d) == own.encode(word * 9, 0, d) for d in range(50))


# 7 quality


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.score(table(ship(spark), sf, "documents")).join(table(spark, sf, "labels"), "doc_id").collect()
    right = sum(r["keep"] == (r["quality"] == 1) for r in scored) / len(scored)
    assert right > 0.97, right
    assert all(r["keep"] for r in scored if r["quality"] == 1)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    cols = []
    for right in (0.95, 0.9, 0.7):
        ok = rng.random(20_000) < right
        cols.append(np.where(good == ok, 1, -1))
    v = np.stack(cols + [np.zeros(20_000, int)] * (len(quality.HEURISTICS) - 3), 1)
    counts = collections.Counter(quality.pattern_of(x) for x in v.tolist())
    m = quality.LabelModel(counts)
    got = list(m.accuracies().values())[:3]
    assert abs(m.prior - 0.8) < 0.03 and all(abs(a - b) < 0.03 for a, b in zip(got, (0.95, 0.9, 0.7), strict=True))


def test_quality_odd(spark, odd):
    rows = quality.score(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[3] == by[4] and by[0] == by[1]
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {0, 1, 3} <= {r["doc_id"] for r in kept.collect()}
    assert quality.score(odd.limit(0)).count() == 0


# 8 toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    rows = toxicity.score(table(ship(spark), sf, "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.02
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_disguise_and_odd_rows(spark, docs, odd):
    model = toxicity.character_model(docs)
    read = toxicity.Reader(model).tokens
    for disguised, meant in (("1d10t", "idiot"), ("stuuuupid", "stupid"), ("p@thetic", "pathetic"), ("m0r0n", "moron"), ("tr@$h", "trash"), ("s c u m", "scum"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("CLOWN!!", "clown"), ("loser###", "loser")):
        assert meant in read(disguised), disguised
    assert read("on the whole") == {"on", "the", "whole"} and read(None) == set()
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["predicted"] == 0 for r in toxicity.score(odd, labels.limit(0)).collect())
    assert toxicity.score(odd.limit(0), labels).count() == 0


def test_spacing_is_in_the_lattice(docs):
    read = toxicity.Reader(toxicity.character_model(docs)).tokens
    cases = {
        "what a i d i o t": "idiot", "i d i o t s t u p i d": "idiot stupid", "b a d": "bad", "i/d/i/o/t": "idiot", "i, d, i, o, t": "idiot", "i   d \n\n i   o\to   t": "idioot",
        "id iot": "idiot", "mo r on": "moron", "a c l o w n you": "clown", "you are a i d 1 0 t now": "idiot", "m o r o n of t r a s h": "moron trash",
    }
    for spaced, meant in cases.items():
        assert set(meant.split()) <= read(spaced), spaced
    assert read("of the thing with that") == {"of", "the", "thing", "with", "that"}
    assert "idiot" * 20 in read("1d10t" * 20)
    assert len(read("x y " * 20_000)) > 2


# 9 pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>a<p>b", "a\nb"), ("<div class='cookie-notice'>x</div><p>hi &amp; <b>b</b>o", "hi & bo"), ("<ul><li>a<li>b</ul>t  \n t", "a\nb\nt t"),
        ("<article><header><h1>T</h1></header><p>x<script>var a='</p>'</script> y</p><aside>no</aside><section class=comments><p>c</p></section></article><p", "T\nx y"),
        ("x < y &lt;b&gt;<!-- <p>no</p> --><br>z", "x < y <b> z"), ("<nav><ul><li>m</ul></nav><main><div>a</div>b</main><footer>f</footer>", "a\nb"), ("<form>f</form><style>p{}</style>t<textarea>no</textarea>", "t"),
        ("<p>" * 3000 + "deep" + "<div>" * 5000 + "er", "deep\ner"), ("a&nbsp;b&am", "a b&am"),
    ],
)
def test_page_text(page, text):
    assert "\n".join(sitetree.texts(sitetree.parse(page or ""))) == text


def test_site_tree(spark):
    """On a site of its own a block that comes back on every page goes, whatever it is called; main text stays."""
    page = lambda i: f"<body><div class=top>Welcome to us {i % 2}</div><div class=body><p>Own text {i}</p><p>The same words</p></div></body>"
    rows = [(i, f"http://A.example/{i}", page(i), 1) for i in range(40)] + [(100, "http://b.example/", page(1), 1), (101, None, None, 1), (102, "no url", page(3), 1)]
    rows += [(200 + i, "http://c.example/", "<article><p>copy</p></article>", 1) for i in range(20)]
    df = ship(spark).createDataFrame(rows, "page_id long, url string, html string, low int")
    got = {r["page_id"]: r for r in sitetree.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text"] == f"Own text {i}\nThe same words" for i in range(40))
    assert got[100]["text"].startswith("Welcome") and got[101]["text"] == "" and got[101]["n_chars"] == 0
    assert all(got[200 + i]["text"] == "copy" for i in range(20))
    assert sitetree.extract(df.limit(0)).count() == 0


# 10 near duplicates


def brute_components(texts, k, most, of):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < k else set(zip(*(w[j:] for j in range(k)), strict=False))
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if of * min(len(x), len(y)) >= most * max(len(x), len(y)) and of * len(x & y) >= most * len(x | y) and (p := root(a)) != (q := root(b)):
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "most"), [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, docs, k, most):
    rng = random.Random(k)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    for i in range(260):  # copies of one text with 0 to 12 edits: a large bucket with links and near misses
        copy = base.copy()
        for _ in range(rng.randrange(13)):
            copy[rng.randrange(120)] = f"e{rng.randrange(900)}"
        rows.append((5000 + i, " ".join(copy)))
    rows += [(9000 + i, t) for i, t in enumerate(ODD[:9])] + [(9100, "A b"), (9101, "a B"), (9102, "a c")]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("label", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, k=k, threshold=(most, 100)).collect()}
    assert got == brute_components(rows, k, most, 100)


def test_near_duplicates_odd(spark, odd):
    rows = neardup.near_duplicates(odd, k=3).collect()
    assert len(rows) == odd.count() and neardup.near_duplicates(odd.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 5000):
        assert (neardup.sketch(rng.integers(1, 2**63, n, dtype=np.uint64)) != ~np.uint64(0)).all()
    x = rng.integers(1, 2**63, 1100, dtype=np.uint64)
    same = [(neardup.sketch(x[a : a + 1000]) == neardup.sketch(x[a + 100 : a + 1100])).mean() for a in [0] * 1]
    assert abs(same[0] - 900 / 1100) < 5 * math.sqrt(0.82 * 0.18 / neardup.T)
