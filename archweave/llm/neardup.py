"""MinHash near-duplicates by fast similarity sketching.

A sketch has ``T`` coordinates. In rounds 0..T-1 every shingle is thrown into one hashed bin; in rounds T..2T-1
every shingle goes to bin (round - T). A coordinate is the least (round, hash) that reached its bin, so every
coordinate fills, and the share of equal coordinates concentrates around the Jaccard similarity. Bands of
coordinates name buckets; sharing a bucket makes a candidate; a candidate becomes a link only when the full
shingle sets pass the threshold.

Copies are folded first: rows with one shingle set form a class and only its first row takes part, so a group of
exact copies costs one aggregate. In a bucket every member is first held against the bucket's smallest member. When
those links are merged, almost all buckets lie inside one component; pairs of different components that still share
a bucket are then compared one by one, so no link between different texts is lost to the shortcut.

Rows are numbered when they are first written, and all that follows goes by these numbers: a bucket, a hub or a
component may hold a third of all rows, and where such a key meets its rows, both are dealt over as many tasks as its
size asks for (``common.meet``). Sets of shingles travel once for each pair that is checked, to the place of its hub.

Defined results: null or empty text, or text without words, gives no shingles, is linked with nothing and is its
own component; texts are read whole; with fewer than ``k`` words the whole sequence is the one shingle; equal
texts share a component; a null id is in a component like any other but names it only where all ids are null; rows that
share an id are documents of their own; an empty table gives an empty result; columns but the id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archweave.llm.common import Stage, by_batch, heat, meet, sifted, spread

T, ROWS = 120, 5
BANDS = T // ROWS
U = np.uint64
_SEEDS = np.random.default_rng(20).integers(1, 2**63, 2 * T, dtype=np.uint64)
_WORDS: dict[bytes, int] = {}
_WORDS_MOST = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hash(word: bytes) -> int:
    if (h := _WORDS.get(word)) is None:
        if len(_WORDS) >= _WORDS_MOST:
            _WORDS.clear()
        h = _WORDS[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; bytes.lower and bytes.split touch ASCII only, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(word_hash, words), U, len(words))
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], U)
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out) + h[i : n + i]
    return np.unique(mix(out))


def sketch(s: np.ndarray) -> np.ndarray:
    """Rounds run until every bin is full; later rounds have larger values and would change nothing."""
    out, step, at = np.full(T, ~U(0)), max(1, 2048 // len(s)), 0
    while at < 2 * T and (at == 0 or (out == ~U(0)).any()):
        rounds = np.arange(at, min(at + step, 2 * T), dtype=U)
        h = mix(s[None, :] ^ _SEEDS[at : at + len(rounds), None])
        bins = ((h >> U(32)) * U(T)) >> U(32)
        late = rounds >= U(T)
        bins[late] = (rounds[late] - U(T))[:, None]
        np.minimum.at(out, bins.ravel().astype(np.intp), ((rounds[:, None] << U(32)) | (h & U(0xFFFFFFFF))).ravel())
        at += step
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), parts.shape[:2])
    for i in range(ROWS):
        key = mix(key + parts[:, :, i])
    return key.view(np.int64)


FINGERPRINT = "doc_id long, tag long, n long, d1 long, d2 long, bands array<long>"


def digest_of(s: np.ndarray) -> int:
    return xxhash.xxh3_128_intdigest(s.tobytes())


def halves(digests: list[int]) -> list[pa.Array]:
    return [pa.array(np.array([(d >> b) & 0xFFFFFFFFFFFFFFFF for d in digests], U).view(np.int64)) for b in (64, 0)]


def fingerprints(k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, sketches = [], [], []
        for text in batch.column(2).to_pylist():
            s = shingles(text, k)
            n.append(len(s))
            digest.append(digest_of(s))
            sketches.append(sketch(s) if len(s) else np.zeros(T, U))
        keys = band_keys(np.stack(sketches))
        bands = pa.ListArray.from_arrays(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32), keys.ravel())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), *halves(digest), bands], ["doc_id", "tag", "n", "d1", "d2", "bands"])

    return by_batch(run)


def shingle_sets(k: int):
    """Sets of (id, d1, d2, text), without texts that only share their tag with the row that was meant."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, k) for t in batch.column(3).to_pylist()]
        d1, d2 = halves([digest_of(s) for s in sets])
        meant = [a == c and b == d for a, b, c, d in zip(d1.to_pylist(), d2.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        at = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        whole = pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, np.concatenate(sets).view(np.int64))], ["id", "s"])
        return whole.filter(pa.array(meant))

    return by_batch(run)


def against(pairs: DataFrame, sets: DataFrame, stage: Stage) -> DataFrame:
    """(a, b, sa, sb): the sets of both ends of each of the distinct ``pairs``, a staged table.

    Both sets go to the place of ``a``, which is several places where ``a`` has many partners.
    """
    most = heat(pairs)
    hubs = stage.write(pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("ways")))
    each = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))
    split = F.broadcast(hubs.filter("ways > 1"))
    parts = pairs.join(split, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("ways", F.lit(1))).cast("int").alias("salt"))
    return parts.join(each("b"), "b").join(spread(hubs).join(each("a"), "a"), ["a", "salt"]).select("a", "b", "sa", "sb")


def linked(pairs: DataFrame, sets: DataFrame, stage: Stage, most: int, of: int) -> DataFrame:
    """Of the pairs (a, b), a staged table, those whose full sets have ``of * intersection >= most * union``."""
    common = against(pairs, sets, stage).select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return common.filter(F.col("i") * of >= most * (F.col("t") - F.col("i"))).select("a", "b")


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(id, label) for every id in ``edges``, label = least id of its component.

    Large-star and small-star steps alternate until nothing changes; each halves the depth, so rounds grow with the
    logarithm of the diameter, and both are aggregates over edges that combine before the shuffle.
    """
    now, told = stage.checked(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        ways = F.ceil(F.count("*") / heat(now, 2)).cast("int").alias("ways")
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w"), ways).select("u", F.least("u", "w").alias("m"), "ways")
        large, told_large = stage.checked(meet(both, least, ["u"], "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # if the large star changes nothing and every u has one v, no v points further: these are stars around the least ids
        if told_large == told and large.groupBy("u").count().filter("count > 1").isEmpty():
            stage.drop(large)
            return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), ways)
        small = meet(large, low, ["u"], "v").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, told = stage.checked(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        stage.drop(now, large)
        now = after


def joined(labels: DataFrame, edges: DataFrame, stage: Stage) -> DataFrame:
    """Labels after more edges, a staged table, have come."""
    if edges.isEmpty():
        return labels
    return stage.write(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(edges), stage))


def relabelled(df: DataFrame, labels: DataFrame, old: str) -> DataFrame:
    """``df`` with the label of each id, or what ``old`` says where it is in no component yet."""
    return df.join(labels.withColumnRenamed("label", "__label"), "id", "left").withColumn("label", F.coalesce("__label", old)).drop("__label")


def by_bucket(members: DataFrame, *what: Column, having: str = "true") -> DataFrame:
    """``what`` of every bucket that fits ``having``, once for each place of the bucket."""
    return spread(members.groupBy("band", "ways").agg(*what).filter(having)).drop("ways")


def mixed(members: DataFrame) -> DataFrame:
    """Members of buckets in which several labels are left."""
    several = by_bucket(members, F.min("label").alias("lo"), F.max("label").alias("hi"), having="lo <> hi")
    return members.join(several.select("band", "salt"), ["band", "salt"], "left_semi")


def pairs_within(x: DataFrame, y: DataFrame, keys: list[str], also: list[str], differ: str) -> DataFrame:
    """Pairs (a, b) of rows of ``x`` and ``y`` that share ``keys`` and fit ``differ``, a condition on columns with _a and _b."""
    x, y = (df.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "label", "most", *also))) for s, df in (("a", x), ("b", y)))
    return x.join(y, keys).filter(differ).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def open_pairs(left: DataFrame, sets: DataFrame, stage: Stage, most: int, of: int, fits: Callable) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that can be links, given the bucket's pivot ``c``.

    What two members share lies inside the pivot's set or outside it. Without a shared shingle outside, their
    intersection is no larger than either one's intersection with the pivot. So a pair is open only if those two are
    large enough for its sizes, or if it shares a shingle that the pivot lacks; such shingles are rare among copies,
    and joining on them makes few pairs where all pairs of a bucket would grow with its square.
    """
    to_pivot = stage.write(left.select(F.col("c").alias("a"), F.col("id").alias("b")).distinct())
    apart = against(to_pivot, sets, stage).select(F.col("a").alias("c"), F.col("b").alias("id"), F.size(F.array_intersect("sb", "sa")).cast("long").alias("i"), F.array_except("sb", "sa").alias("out"))
    apart = stage.write(apart)
    differ = f"id_a < id_b AND label_a <> label_b AND {fits(('most_a', 'n_a'), ('most_b', 'n_b'))}"
    least = by_bucket(left, F.min("n").alias("n_least"))
    near = stage.write(left.join(apart.select("c", "id", "i"), ["c", "id"]).join(least, ["band", "salt"]).filter(f"{of} * i >= {most} * (n + n_least - i)"))
    inside = pairs_within(near, spread(near.drop("salt")), ["band", "salt"], ["i"], f"{differ} AND {of} * least(i_a, i_b) >= {most} * (n_a + n_b - least(i_a, i_b))")
    rare = apart.select("c", "id", F.explode("out").alias("e"))
    shared = rare.groupBy("c", "e").agg(F.count("*").alias("k")).filter("k > 1").select("c", "e")
    rare = stage.write(rare.join(shared, ["c", "e"]).join(left.select("id", "n", "label", "most").distinct(), "id"))
    out = stage.write(inside.union(pairs_within(rare, rare, ["c", "e"], [], differ)).distinct())
    stage.drop(to_pivot, apart, near, rare)
    return out


def heads_of(docs: DataFrame, tag: Column, k: int, threshold: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, tag, row, n, and ``head``, the first row (nameless, doc_id, tag, row) of its component; null without shingles.

    ``tag`` hashes the row, its id and text at least.
    """
    most, of = threshold
    stage = Stage(docs.sparkSession, "neardup")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"), F.col(text_col).alias("text"))
    printed = stage.write(slim.mapInArrow(fingerprints(k), FINGERPRINT).withColumn("row", F.monotonically_increasing_id()))
    hot = heat(printed)
    head = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag", "row")).alias("head")
    classes = stage.write(printed.filter("n > 0").groupBy("d1", "d2").agg(head, F.min("n").alias("n"), F.ceil(F.count("*") / hot).cast("int").alias("ways")).withColumn("id", F.col("head.row")))
    rows = printed.select(F.col("row").alias("id"), "bands").join(classes.select("id"), "id", "left_semi").select("id", F.explode("bands").alias("band"))
    places = F.ceil(F.count("*") / heat(classes, BANDS)).cast("int").alias("ways")
    buckets = stage.write(rows.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("size"), places).filter("size > 1").drop("size"))
    members = stage.write(meet(rows, buckets, ["band"], "id"))
    every = stage.write(printed.drop("bands"))
    stage.drop(printed, buckets)

    alike = f"{of} * least(n_a, n_b) >= {most} * greatest(n_a, n_b)"
    size = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"))
    star = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    star = stage.write(star.join(size("a"), "a").join(size("b"), "b").filter(alike).select("a", "b"))
    named = stage.write(classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "d1", "d2", "n", "head.tag"))
    # the texts of documents that share no bucket are filtered out where they lie, not after a shuffle of all texts
    with sifted(docs.sparkSession):
        sets = stage.write(slim.join(named.filter("n > 0"), "tag").select("id", "d1", "d2", "text").mapInArrow(shingle_sets(k), "id long, s array<long>"))
    if sets.count() > named.count():  # rows that repeat
        sets = stage.write(sets.dropDuplicates(["id"]))
    labels = stage.write(components(stage.write(linked(star, sets, stage, most, of)), stage))

    found = stage.write(relabelled(members, labels, "id"))
    found = stage.write(mixed(found).join(classes.select("id", "n"), "id").select("band", "ways", "salt", "id", "n", "label"))
    stage.drop(members, named)
    # a shingle that no other open document has is in no intersection: so many can be shared at most, and the union is
    # at least the rest. Copies with too many edits of their own fall out here, before any pair is made
    few = stage.write(sets.join(found.select("id").distinct(), "id", "left_semi"))
    stage.drop(sets)
    sets = few
    own = sets.select("id", F.explode("s").alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("own"))
    open_ = stage.write(found.join(own, "id", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).drop("own").filter(f"{of} * most >= {most} * n"))
    # the member with the fewest shingles of its own stands nearest to what a bucket's members were copied from
    fits = lambda x, y: f"{of} * least({x[0]}, {y[0]}) >= {most} * ({x[1]} + {y[1]} - least({x[0]}, {y[0]}))"
    central = stage.write(by_bucket(open_, F.min_by(F.struct("id", "n", "label", "most"), F.struct((F.col("n") - F.col("most")) / F.col("n"), "id")).alias("h")))
    second = open_.join(central, ["band", "salt"]).filter(f"label <> h.label AND {fits(('most', 'n'), ('h.most', 'h.n'))}")
    second = stage.write(second.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    labels = joined(labels, stage.write(linked(second, sets, stage, most, of)), stage)
    left = stage.write(relabelled(open_, labels, "label"))
    left = stage.write(mixed(left).join(central.select("band", "salt", F.col("h.id").alias("c")), ["band", "salt"]))
    if not left.isEmpty():
        rest = stage.write(open_pairs(left, sets, stage, most, of, fits).join(star.union(second), ["a", "b"], "left_anti"))
        labels = joined(labels, stage.write(linked(rest, sets, stage, most, of)), stage)
    stage.drop(sets, found, open_, central, left, star, second)

    firsts = labels.join(classes.select("id", "head"), "id").groupBy("label").agg(F.min("head").alias("first"), F.ceil(F.count("*") / hot).cast("int").alias("ways"))
    firsts = meet(labels, stage.write(firsts), ["label"], "id").select("id", "first")
    of_class = stage.write(classes.join(firsts, "id", "left").select("d1", "d2", "ways", F.coalesce("first", "head").alias("head")))
    out = meet(every.filter("n > 0"), of_class, ["d1", "d2"], "row").select("doc_id", "tag", "row", "n", "head")
    return out.unionByName(every.filter("n = 0").select("doc_id", "tag", "row", "n"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least id reachable over links), kept."""
    out = heads_of(docs, F.xxhash64(F.col(id_col).cast("long"), text_col), k, threshold, id_col, text_col)
    comp = F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, *, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the least id, then of the least hash.

    Decided by row, so rows that share an id or have none are told apart by what they hold, and of rows that are equal
    in every column one stays. Rows without shingles are copies of nothing and all stay.
    """
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    tag, key = F.xxhash64(*plain), ["at", "tag"]
    at = lambda c: F.coalesce(c.cast("long"), F.lit(0)).alias("at")
    rows = heads_of(docs, tag, k, threshold, id_col, text_col).select(at(F.col("doc_id")), "tag", (F.col("n") == 0).alias("bare"), F.coalesce(F.col("row") == F.col("head.row"), F.lit(False)).alias("first"))
    told = rows.filter("NOT bare").groupBy(*key).agg(F.max("first").alias("stays"), F.count("*").alias("c")).filter("NOT stays OR c > 1")
    told = Stage(docs.sparkSession, "keep-one").write(told)
    marked = docs.select(at(F.col(id_col)), tag.alias("tag"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = marked.join(told, key, "left_anti")
    again = told.filter("stays")
    if not again.isEmpty():
        kept = kept.union(marked.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))
