"""Flows: what every entry point leads to, in depth-first order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.window import Window

from archweave.graph import Graph
from archweave.operators.aggregate import ENTRY_POINT_TYPES, G
from archweave.plans.fixpoint import Rounds, least_by_key

#: Parts in which links are brought to their ends: what is shuffled at once is a part of them.
SLICES = 2
#: Parts of each slice, at least.
PARTS = 192
FIRST_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Entry points of a block: at most, at least where blocks are few for the cores, and at least where cores have none.
ENTRIES, FEWER_ENTRIES, LEAST_ENTRIES = 8192, 4096, 64
#: Links that a block may reach to be walked by one task.
MOST_LINKS = 8_000_000
#: Places of nodes that lead nowhere, kept for the entry points that are told of together.
CELLS = 2_000_000


def _own(column: str, i: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SLICES)) == i


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each component of a part: its links in order, each target once, and where it is an entry point its place.

    A row that is no link tells of ``id`` only: with ``known`` a component (``ord`` where it is of an entry type), else that a link targets it.
    """
    if not (parts := [b for b in batches if b.num_rows]):
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    one = lambda c: table[c].chunk(0)
    plain = lambda x, none: pc.fill_null(x, none).to_numpy(zero_copy_only=False)
    graphs, ids = one(G).dictionary_encode(), one("id").dictionary_encode()
    node = ids.indices.to_numpy().astype(np.int64)
    if len(graphs.dictionary) > 1:
        node = np.unique(graphs.indices.to_numpy() * np.int64(len(ids.dictionary)) + node, return_inverse=True)[1]
    n, top = int(node.max()) + 1, np.iinfo(np.int64).max
    first = np.empty(n, np.int64)
    first[node] = np.arange(len(node))
    role, ord_ = plain(one("role"), 0), plain(one("ord"), top)
    known, met, place = np.zeros(n, bool), np.zeros(n, bool), np.full(n, top)
    known[node[role == COMPONENT]] = True
    met[node[role == TARGET]] = True
    np.minimum.at(place, node[role == COMPONENT], ord_[role == COMPONENT])
    at = np.flatnonzero((role == LINK) & known[node])
    target = one("target").take(pa.array(at)).dictionary_encode()
    to = plain(target.indices, len(target.dictionary)).astype(np.int64)
    by = np.lexsort((ord_[at], node[at]))
    if len(at) and ((node[at][by][1:] == node[at][by][:-1]) & (ord_[at][by][1:] == ord_[at][by][:-1])).any():
        rank = np.append(np.argsort(pc.sort_indices(target.dictionary).to_numpy()), -1)
        by = np.lexsort((rank[to], ord_[at], node[at]))
    at, to = at[by], to[by]
    begins = np.flatnonzero(np.append(True, node[at][1:] != node[at][:-1])) if len(at) else at
    kind = np.full(n, len(table))
    kind[node[at[begins]]] = at[begins]
    _, once = np.unique(node[at] * (len(target.dictionary) + 1) + to, return_index=True)
    once = np.sort(once)
    once = once[to[once] < len(target.dictionary)]  # a link to nothing
    rows = np.flatnonzero(known)
    sizes = np.bincount(node[at[once]], minlength=n)[rows]
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    cols = {
        G: one(G).take(pa.array(first[rows])), "id": one("id").take(pa.array(first[rows])), "entry": pa.array(place[rows], mask=met[rows] | (place[rows] == top)),
        "targets": pa.ListArray.from_arrays(pa.array(ends), target.dictionary.take(pa.array(to[once]))), "n_targets": pa.array(sizes.astype(np.int64)),
        "link_type": one("type").take(pa.array(kind[rows], mask=kind[rows] == len(table))),
    }
    out = pa.RecordBatch.from_pydict(cols)
    for i in range(0, len(out), 20_000):
        yield out.slice(i, 20_000)


#: What a row tells of its ``id``.
COMPONENT, LINK, TARGET = 1, 2, 3
NODES = "graph_id string, id string, entry long, targets array<string>, n_targets long, link_type string"


def _nodes(graph: Graph, rounds: Rounds) -> tuple[DataFrame, str]:
    """``NODES`` of every component: ``entry`` is an entry point's place in its document, ``targets`` what it links to, in order, ``link_type`` that of its first link.

    Links are read once for each slice; what they say of both ends and the components go by id in one shuffle.
    """
    none = lambda t: F.lit(None).cast(t)
    out = F.struct(F.lit(LINK).alias("role"), F.col("source").alias("id"), "ord", "target", "type")
    into = F.struct(F.lit(TARGET).alias("role"), F.col("target").alias("id"), none("long").alias("ord"), none("string").alias("target"), none("string").alias("type"))
    links = graph.links.select(G, F.explode(F.array(out, into)).alias("x")).select(G, "x.*")
    own = F.when(F.col("type").isin(*ENTRY_POINT_TYPES), F.col("ord"))
    components = graph.components.select(G, F.lit(COMPONENT).alias("role"), "id", own.alias("ord"), none("string").alias("target"), none("string").alias("type"))

    def one(i: int) -> DataFrame:
        told = components.filter(_own("id", i)).unionByName(links.filter(_own("id", i)))
        return told.repartition(G, "id").mapInArrow(_group, NODES)

    conf = graph.spark.conf
    before = conf.get(FIRST_PARTS, None)
    conf.set(FIRST_PARTS, max(PARTS, int(conf.get("spark.sql.shuffle.partitions"))))  # a task holds its part; small ones are joined
    try:
        return rounds.append(one(i) for i in range(SLICES))
    finally:
        if before is None:
            conf.unset(FIRST_PARTS)
        else:
            conf.set(FIRST_PARTS, before)


def _blocks(graph: Graph, nodes: DataFrame) -> tuple[DataFrame, int]:
    """Entry points with their block, and how many there are: those that stand near each other in their document in one block."""
    found = nodes.filter("entry IS NOT NULL")
    n, cores = found.count(), graph.spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // ENTRIES), min(4 * cores, -(-n // FEWER_ENTRIES)), min(cores, -(-n // LEAST_ENTRIES)))
    return found.repartitionByRange(blocks, G, "entry", "id").withColumn("block", F.spark_partition_id()), blocks


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a block: its nodes by their places in ``names``, so that a link is a number."""
    table = pa.Table.from_batches(list(batches))
    whole = lambda c: pa.concat_arrays(table[c].chunks)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    names, lists = whole("id"), whole("targets")
    to = pc.index_in(lists.flatten(), value_set=names)
    known = to.is_valid()  # others are no components
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(names)), n)[known.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(of, minlength=len(names)).astype(np.int32)
    starts = np.flatnonzero(whole("start").to_numpy(zero_copy_only=False)).astype(np.int32)
    cols = {G: table[G].chunk(0)[:1], "names": one(names), "types": one(whole("link_type")), "starts": one(pa.array(starts)), "sizes": one(pa.array(sizes)), "targets": one(to.filter(known).cast(pa.int32()))}
    yield pa.RecordBatch.from_pydict(cols | ({"carried": one(whole("carried"))} if "carried" in table.column_names else {}))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The flows of each block's entry points, walked depth first over the links that all of them can reach."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield from _walk_block(batch.slice(i, 1))


def _walk_block(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Only nodes that lead on are walked one by one. What else they link to lies between them in runs; each entry keeps of those the first place of each node."""
    part = lambda c: block[c].flatten()
    graph_id, names, types, carried = block[G][0], part("names"), part("types"), "carried" in block.schema.names
    to, sizes = part("targets").to_numpy(), part("sizes").to_numpy()
    also = part("carried") if carried else None
    wanted = also.is_valid().to_numpy(zero_copy_only=False) if carried else None
    n, ends = len(names), np.cumsum(sizes, dtype=np.int64)
    leaf = sizes == 0
    heads = np.arange(n) + ends - sizes  # every node stands before what it links to
    line = np.empty(n + len(to), np.int32)
    is_head = np.zeros(len(line), bool)
    is_head[heads] = True
    line[is_head], line[~is_head] = np.arange(n), to
    inner = ~is_head & ~leaf[line]  # a run ends where a link leads on
    own = np.flatnonzero(is_head | inner)
    shift = np.cumsum(inner)
    begin = np.where(is_head[own], own - shift[own], own + 1 - shift[own])
    length = np.diff(np.append(begin, len(line) - inner.sum()))
    runs, is_head = line[~inner], is_head[~inner]
    head_run = np.flatnonzero(~inner[own])  # of each node
    onward, more = line[own].tolist(), (length > 0).tolist()
    run_of = [*head_run.tolist(), len(own)]
    del line, inner, shift, heads, ends, own, head_run
    width = int(leaf.sum()) + 1
    number = np.where(leaf, np.cumsum(leaf) - 1, width - 1)
    most = max(1, CELLS // width)
    first = np.empty(most * width, np.int64)

    def told(entries: list[int], walked: list[np.ndarray], depths: list[int]) -> pa.RecordBatch:
        seg, by_entry = np.concatenate(walked), np.array([len(x) for x in walked])
        long = length[seg]
        after = np.cumsum(long)
        place = np.arange(after[-1])
        of = np.repeat(begin[seg] - after + long, long) + place
        at, which = runs[of], np.repeat(np.repeat(np.arange(len(entries)), by_entry), long)
        key = which * width + number[at]
        first[key[::-1]] = place[::-1]
        keep = (first[key] == place) | ~leaf[at]
        at, which, deep = at[keep], which[keep], (np.repeat(np.array(depths), long) + ~is_head[of])[keep]
        count = np.bincount(which, minlength=len(entries))
        step = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(count) - count, count)
        if carried:
            some = wanted[at]
            which, at, deep, step = which[some], at[some], deep[some], step[some]
        at = pa.array(at)
        cols = [pa.repeat(graph_id, len(at)), names.take(pa.array(np.array(entries)[which])), names.take(at), pa.array(deep), pa.array(step), types.take(at)]
        return pa.RecordBatch.from_arrays(cols + ([also.take(at)] if carried else []), [G, "entry", "id", "depth", "step", "link_type"] + ["carried"] * carried)

    entries, walked, depths, met = [], [], [], 0
    for e in part("starts").to_pylist():
        seen, segs, after = {e}, [run_of[e]], [-1]
        depths.append(0)
        stack = [iter(range(run_of[e] + 1, run_of[e + 1]))]
        while stack:
            for run in stack[-1]:
                if (k := onward[run]) not in seen:
                    seen.add(k)
                    segs.append(run_of[k])
                    depths.append(len(stack))
                    if run_of[k] + 1 < run_of[k + 1]:
                        stack.append(iter(range(run_of[k] + 1, run_of[k + 1])))
                        after.append(run)
                        break
                if more[run]:
                    segs.append(run)
                    depths.append(len(stack) - 1)
            else:
                stack.pop()
                if (run := after.pop()) >= 0 and more[run]:
                    segs.append(run)
                    depths.append(len(stack) - 1)
        entries.append(e)
        walked.append(np.array(segs))
        met += int(length[walked[-1]].sum())
        if met >= 100_000 or len(entries) == most:
            yield told(entries, walked, depths)
            entries, walked, depths, met = [], [], [], 0
    if entries:
        yield told(entries, walked, depths)


def flows(graph: Graph, of: DataFrame | None = None, *, most_links: int = MOST_LINKS) -> DataFrame:
    """(graph_id, entry, id, depth, step, link_type): depth-first preorder from every entry point.

    ``link_type`` is that of the node's first outgoing link. Given ``of`` (graph_id, id, carried), the steps at its ids
    only, with ``carried``; their places are those in the whole flow.

    Entry points go in blocks. What a block reaches is found breadth first, each node once for the block and with the
    links that leave it; that is written as one row of numbers for a block, some blocks at a time, and the files of the
    search go. The block's flows are walked over its row as the result is read, so reading it shuffles nothing and flows
    themselves are not written. Blocks that reach more than ``most_links`` links go by ``least_flows``.
    """
    rounds = Rounds(graph.spark)
    nodes, nodes_at = _nodes(graph, rounds)
    what = [G, "block", "id", "start", "targets", "n_targets", "link_type"]
    entries, n = _blocks(graph, nodes)
    new, at = rounds.save(entries.withColumn("start", F.lit(True)).select(what))
    paths = [at]
    while not new.isEmpty():
        met = new.select(G, "block", F.explode("targets").alias("id")).distinct()
        met = met.join(rounds.load(paths, new).select(G, "block", "id"), [G, "block", "id"], "left_anti").withColumn("start", F.lit(False))
        new, at = rounds.save(met.hint("shuffle_hash").join(nodes, [G, "id"]).select(what))
        paths.append(at)
    rounds.drop(nodes_at)
    rows = rounds.load(paths, new)
    wide, _ = rounds.save(rows.groupBy("block", G).agg(F.sum("n_targets").alias("n")).filter(F.col("n") > most_links).select("block", G))
    some = not wide.isEmpty()
    near = rows.join(wide, ["block", G], "left_anti") if some else rows
    if some:
        far, _ = rounds.save(rows.filter("start").join(wide, ["block", G], "left_semi").select(G, F.col("id").alias("entry")))
    kind = StructType().add(G, "string").add("entry", "string").add("id", "string").add("depth", "long").add("step", "long").add("link_type", "string")
    packed = StructType().add(G, "string")
    for c, what_in in (("names", StringType()), ("types", StringType()), ("starts", IntegerType()), ("sizes", IntegerType()), ("targets", IntegerType())):
        packed = packed.add(c, ArrayType(what_in))
    if of is not None:
        near = near.join(of, [G, "id"], "left")
        kind = kind.add("carried", near.schema["carried"].dataType)
        packed = packed.add("carried", ArrayType(near.schema["carried"].dataType))
    slices = SLICES if n >= SLICES * graph.spark.sparkContext.defaultParallelism else 1

    def one(i: int) -> DataFrame:
        own = near.filter(F.pmod("block", F.lit(slices)) == i) if slices > 1 else near
        return own.drop("n_targets").repartition(-(-n // slices), "block").groupBy("block", G).applyInArrow(_pack, packed)

    walked, _ = rounds.append(one(i) for i in range(slices))
    for path in paths:
        rounds.drop(path)
    graph.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # blocks that a worker holds at once
    out = walked.mapInArrow(_walk, kind)
    if not some:
        return out
    far = least_flows(graph, far)
    return out.unionByName(far if of is None else far.join(of, [G, "id"]))


def least_flows(graph: Graph, entries: DataFrame) -> DataFrame:
    """As ``flows``, for the given (graph_id, entry), by label correcting: no task holds more than rows.

    A node's place is the least path of link ordinals that leads to it, its depth the length of that path: of two paths
    the smaller one is walked first. A path that comes back to a node starts with a smaller one to it, so it is never
    kept, and least paths are simple by themselves. Every round writes the paths that got better.
    """
    ids = graph.components.select(G, "id").distinct()
    edges = graph.links.select(G, "ord", "source", "target").join(ids.withColumnRenamed("id", "source"), [G, "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), [G, "target"], "left_semi")
    hop, _ = Rounds(graph.spark).save(edges.select(G, F.col("source").alias("id"), "target", "ord"))
    start = entries.select(G, "entry", F.col("entry").alias("id"), F.array().cast("array<bigint>").alias("path"))

    def step(new: DataFrame) -> DataFrame:
        return new.join(hop, [G, "id"]).select(G, "entry", F.col("target").alias("id"), F.concat("path", F.array("ord")).alias("path"))

    best = least_by_key(start, step, [G, "entry", "id"], "path")
    first = graph.links.groupBy(G, F.col("source").alias("id")).agg(F.min_by(F.struct("type"), "ord")["type"].alias("link_type"))
    at = F.row_number().over(Window.partitionBy(G, "entry").orderBy("path")).cast("long")
    return best.select(G, "entry", "id", F.size("path").cast("long").alias("depth"), at.alias("step")).join(first, [G, "id"], "left").select(G, "entry", "id", "depth", "step", "link_type")


def flow_external_links(graph: Graph) -> DataFrame:
    """The links to the outside of each flow step."""
    x = graph.external_links.groupBy(G, F.col("source").alias("id")).agg(F.collect_list(F.struct(F.col("ord").alias("external_ord"), F.col("target.name").alias("external_name"))).alias("carried"))
    return flows(graph, x).select("*", F.inline("carried")).drop("carried")
