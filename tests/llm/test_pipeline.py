"""The corpus pipeline, each stage on its own input against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from archweave.llm import mixing
from archweave.llm.common import table
from tests.llm.test_operators import DOC, ODD, PLAIN, SF, brute_components, luhn


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage over a small corpus with odd documents."""
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(70_000 + i, t, None, "odd", None) for i, t in enumerate(ODD)] + [(None, "nobody's text is kept as well as it was", "en", None, 1)], DOC)
    docs = docs.unionByName(odd)
    out = []
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, docs, SF).cache()
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return {n: x for n, *x in out}


def plain_mask(text):
    if text is None:
        return None
    iban = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"

    def fine(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "iban":
            v = v.replace(" ", "")
            return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    for kind, p in {**PLAIN, "iban": iban}.items():
        text = re.sub(p, lambda m, k=kind: f"<{k}>" if fine(k, m[0]) else m[0], text)
    return text


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "pii", "mixing", "sentencepiece"]
    for name, (_, _, before, after) in stages.items():
        assert name == "sentencepiece" or before == after


def test_quality_drops_junk_only(spark, stages):
    before, after, *_ = stages["quality"]
    kept = {r["doc_id"] for r in after}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert all((i in kept) == (q == 1) for i, q in labels.items()) and 0 < len(before) - len(after) < 0.3 * len(before)
    assert {70_000, 70_001, 70_003, 70_005} <= kept


def test_one_of_each_group_stays(stages):
    before, after, *_ = stages["near-dedup"]
    want = {i for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], 5, 80, 100).items() if c == i}
    assert {r["doc_id"] for r in after if r["doc_id"] is not None} == want and sum(r["doc_id"] is None for r in after) == 1


def test_masks(stages):
    before, after, *_ = stages["pii"]
    assert sorted((str(r["doc_id"]), plain_mask(r["text"]) or "") for r in before) == sorted((str(r["doc_id"]), r["text"] or "") for r in after)
    assert any(r["text"] != s for r, s in zip(after, [r["text"] for r in before], strict=True))


def test_mixing_and_pieces_keep_every_row(stages):
    before, after, *_ = stages["mixing"]
    assert sorted(map(str, before)) == sorted(map(str, after))
    texts = {r["doc_id"]: r["text"] or "" for r in after}
    rows = stages["sentencepiece"][1]
    assert len(rows) == len(after) and all(r["lossless"] and r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 100 and all(r["lossless"] for r in rows)


def test_run_is_in_slot_order(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = table(spark, SF, "documents").filter(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    slots = {r["doc_id"]: r["mix_slot"] for r in mixing.mix(kept).collect()}
    assert [r["mix_slot"] for r in rows] == [slots[r["doc_id"]] for r in rows] == sorted(slots.values()) and len(set(slots.values())) > 3
