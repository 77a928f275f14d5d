"""The call graph: name map, call resolution, links, PageRank, impact, neighbourhoods and paths.

Tables: methods (id, name, class_name, file_path, chunk_type, signature, line_start, line_end, is_primary), edges (src, dst,
edge_type, confidence, call_count). All operators are joins and aggregates over them; loops write each round's table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.work import checkpointed, discard

#: Starts that walk together, each a bit of a word.
WORD = 64
#: Calls of a cell of the ranks' grid: least and most, about; those in one row of its table. Lanes in which a block is numbered.
LEAST_CELL, MOST_CELL, SLICE, LANES = 50_000, 8_000_000, 4_000_000, 16
#: Rows that the references of a piece make, about; names whose references go in pieces are broadcast up to so many.
PIECE, FEW = 4_000_000, 100_000
SUMS = "block int, row int, given binary"
CALLS, IMPLEMENTS, BELONGS_TO = "CALLS", "IMPLEMENTS", "BELONGS_TO"


def name_map(methods: DataFrame) -> DataFrame:
    """JOIN-4: key (`name` and `Class.name`) and id of every primary method; SQL statements are not in it."""
    rows = methods.where((F.coalesce("chunk_type", F.lit("method")) != "sql") & F.coalesce("is_primary", F.lit(True)) & (F.coalesce("name", F.lit("")) != ""))
    names = F.array(F.col("name"), F.when(F.coalesce("class_name", F.lit("")) != "", F.concat("class_name", F.lit("."), "name")))
    return rows.select("id", F.explode(F.array_compact(names)).alias("key"))


def resolve_calls(calls: DataFrame, methods: DataFrame, digits: int | None = None) -> DataFrame:
    """JOIN-3: callees of each call (caller, ref, pos): caller, ref, pos, callee, confidence (rounded to digits, if given).

    A reference goes to every method of that key but the caller. If no method has the key and the reference is dotted, it
    goes to the one method of its last name, if there is just one and it is not the caller. Confidence is 1.0 for dotted
    references and 0.7 for bare ones, shared evenly by the callees.

    The references of a name that many methods share are few bytes and make very many rows. So they are dealt by the rows that they
    will make, about PIECE together, and meet all methods of the name in each piece.
    """
    keys = name_map(methods)
    refs = checkpointed(_references(calls, keys, digits), "references")
    reached = _reached(keys)
    made = reached.groupBy("exact", "key").agg(F.count("*").alias("n")).join(refs.groupBy("exact", "key").agg(F.count("*").alias("m")).hint("merge"), ["exact", "key"])
    dealt = made.select("exact", "key", F.ceil(F.col("n") * F.col("m") / PIECE).cast("int").alias("pieces")).where("pieces > 1")
    dealt = checkpointed(dealt, "reference-pieces")
    dealt = F.broadcast(dealt) if dealt.count() <= FEW else dealt.hint("merge")
    parts = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * calls.sparkSession.sparkContext.defaultParallelism)
    at, pieces = ["exact", "key", "piece"], F.coalesce("pieces", F.lit(1))
    refs = refs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).join(dealt, ["exact", "key"], "left")
    refs = refs.select("exact", "key", F.pmod(F.xxhash64("caller", "ref", "pos"), pieces).cast("int").alias("piece"), "caller", "ref", "pos", "confidence")
    reached = reached.join(dealt, ["exact", "key"], "left").select("exact", "key", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.col("id").alias("callee"))
    met = refs.repartition(parts, *at).join(reached.repartition(parts, *at).hint("merge"), at)
    return met.where("callee <> caller").select("caller", "ref", "pos", "callee", "confidence")


def _references(calls: DataFrame, keys: DataFrame, digits: int | None = None) -> DataFrame:
    """Each (caller, ref, pos) that a method may answer once, with its repetitions (times), the key that it goes by and whether that is the whole reference (exact) or its last name, and the confidence of each of its callees.

    A reference's callees are counted from its key's methods less the caller's own, so that no row for each callee is shuffled or sorted.
    Tables of methods are not broadcast: their files tell little of how many there are.
    """
    known = keys.groupBy(F.col("key").alias("ref")).agg(F.count("*").alias("n"), F.lit(True).alias("exact"))
    refs = calls.groupBy("caller", "ref", "pos").agg(F.count("*").alias("times"))
    own = keys.groupBy(F.col("id").alias("caller"), F.col("key").alias("ref")).agg(F.count("*").alias("own"))
    seen = refs.join(own.hint("merge"), ["caller", "ref"], "left").join(known.hint("merge"), "ref", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    dotted = F.col("ref").contains(".")
    callees = (F.col("n") - F.coalesce("own", F.lit(0).cast("long"))) * F.col("times")
    share = F.when(F.col("exact"), F.when(dotted, 1.0).otherwise(0.7) / F.when(callees > 0, callees)).otherwise(1.0 / F.col("times"))
    key = F.when(F.col("exact"), F.col("ref")).otherwise(F.substring_index("ref", ".", -1))
    return seen.where(F.col("exact") | dotted).select("caller", "ref", "pos", "times", "exact", key.alias("key"), (share if digits is None else F.round(share, digits)).alias("confidence"))


def _reached(keys: DataFrame) -> DataFrame:
    """exact, key, id: the methods that whole references reach, and those that last names do, which are the only ones of their key."""
    only = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return keys.select(F.lit(True).alias("exact"), "key", "id").unionByName(only.select(F.lit(False).alias("exact"), "key", "id"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """AGG-7: one edge for each (caller, callee): number of references, and the confidence of the first."""
    return resolved.groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.count("*").alias("call_count"), F.min_by("confidence", F.struct("pos", "ref")).alias("confidence")).withColumn("edge_type", F.lit(CALLS))


def resolved_edges(calls: DataFrame, methods: DataFrame, digits: int | None = None) -> DataFrame:
    """call_edges(resolve_calls(calls, methods, digits)), for names that very many methods share.

    Methods of the same keys are one group: a caller's references are added up by group, and only then do its methods, but the caller
    itself, take the place of the group. So what is shuffled grows with references and groups, and edges are only written.
    """
    keys = name_map(methods)
    of = keys.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    names = of.groupBy("keys").agg(F.min("id").alias("group"))  # a group goes by its smallest method
    members = of.join(names.hint("merge"), "keys").select("group", "id")
    # A group that a caller reaches by a last name has one method with that name, and so one method, by whose id it goes.
    groups = names.select(F.explode("keys").alias("key"), F.lit(True).alias("exact"), "group").unionByName(_reached(keys).where("not exact").withColumnRenamed("id", "group"))
    found = _references(calls, keys, digits).join(groups.hint("merge"), ["exact", "key"])
    added = found.groupBy("caller", "group").agg(F.sum("times").alias("call_count"), F.min_by("confidence", F.struct("pos", "ref")).alias("confidence"))
    out = added.join(members.hint("merge"), "group").where("id <> caller")
    return out.select(F.col("caller").alias("src"), F.col("id").alias("dst"), "call_count", "confidence", F.lit(CALLS).alias("edge_type"))


def existing_edges(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """JOIN-5: edges both of whose ends are methods."""
    ids = methods.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def belongs_to(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """JOIN-1: method to every class of its class name, in whatever file."""
    named = methods.where(F.coalesce("class_name", F.lit("")) != "").select(F.col("id").alias("src"), F.col("class_name"))
    return named.join(classes.select(F.col("id").alias("dst"), F.col("name").alias("class_name")), "class_name").select("src", "dst").distinct().withColumn("edge_type", F.lit(BELONGS_TO))


def implements(methods: DataFrame) -> DataFrame:
    """JOIN-2: Java method to the SQL statement of the same class and name."""
    left = methods.where((F.coalesce("chunk_type", F.lit("method")) == "method") & F.col("file_path").endswith(".java"))
    right = methods.where(F.col("chunk_type") == "sql")
    keys = ["class_name", "name"]
    return left.select(F.col("id").alias("src"), *keys).join(right.select(F.col("id").alias("dst"), *keys), keys).select("src", "dst").distinct().withColumn("edge_type", F.lit(IMPLEMENTS))


def in_degree(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-9: id and in_degree (calls that reach it) of every method."""
    counts = edges.where(F.col("edge_type") == CALLS).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return methods.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("in_degree"))


def pagerank(methods: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, keep: int = 5) -> DataFrame:
    """AGG-16: id and pagerank after rounds of `1 - damping + damping * sum(rank / out-degree)`; what reaches a method without calls is dropped.

    Methods are dealt to a few blocks and numbered there; the calls from a block to a block are a cell. Cells are written once and
    kept where they are, and so are out-degrees; a round sends a block's ranks to the cells of its row, and a cell's sums to the
    block of its column. So it shuffles a number a method and side of the grid, twice, however many calls there are. Every
    keep-th round and the last are written, so that lineage stays short; a lost executor's part of the cells is made again from
    what was written. Repeated edges count as often as they occur.
    """
    calls = checkpointed(edges.where(F.col("edge_type") == CALLS).select("src", "dst"), "pagerank-calls")
    side = _side(calls.count(), calls.sparkSession.sparkContext.defaultParallelism)
    nodes = checkpointed(_numbered(methods.select("id").distinct(), side), "pagerank-nodes")
    size = (nodes.agg(F.max("at")).first()[0] or 0) + 1
    made = checkpointed(_placed(calls, nodes, side).groupBy("row", "col").applyInArrow(_cell(size), "row int, col int, src binary, dst binary, degrees binary"), "pagerank-cells")
    cells = made.select("row", "col", "src", "dst").repartition(side * side, "row", "col").persist()
    blocks = calls.sparkSession.range(side).select(F.col("id").cast("int").alias("row"), F.lit(None).cast("binary").alias("degrees"))
    degrees = blocks.unionByName(made.where("degrees IS NOT NULL").select("row", "degrees")).groupBy("row").applyInArrow(_degrees(size), "block int, degrees binary").repartition(side, "block").persist()
    sums = calls.sparkSession.createDataFrame([], SUMS)
    for k in range(rounds + 1):
        given = _given(size, damping, shared=k < rounds)
        ranks = degrees.groupBy("block").cogroup(sums.repartition(side, "block").groupBy("block")).applyInArrow(given, "block int, lane int, rank binary")
        if k == rounds or k and k % keep == 0:
            ranks = checkpointed(ranks, "pagerank")
        if k < rounds:
            sent = ranks.select(F.col("block").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("col"), "rank").repartition(side * side, "row", "col")
            sums = cells.groupBy("row", "col").cogroup(sent.groupBy("row", "col")).applyInArrow(_sums(size), SUMS)
    cells.unpersist()
    degrees.unpersist()
    discard(calls, made)
    kind = nodes.schema["id"].dataType.simpleString()
    named = nodes.select("id", "block", (F.col("at") % LANES).alias("lane"), F.floor(F.col("at") / LANES).alias("place"))
    return named.groupBy("block", "lane").cogroup(ranks.groupBy("block", "lane")).applyInArrow(_ranked, f"id {kind}, pagerank double")


def _side(calls: int, cores: int) -> int:
    """Blocks of the grid: about three cells a core, fewer for few calls, and more where a cell would have over MOST_CELL calls. Between those it is fixed, so that what a round sends grows as the methods do."""
    return max(min(math.ceil(math.sqrt(3 * cores)), math.ceil(math.sqrt(calls / LEAST_CELL))), math.ceil(math.sqrt(calls / MOST_CELL)), 1)


def _numbered(ids: DataFrame, side: int) -> DataFrame:
    """id, block, at: ids dealt to side blocks, and nearly gapless numbers there. A block is numbered in LANES lanes, none of which waits for another."""
    lane = F.pmod(F.xxhash64("id"), F.lit(side * LANES)).cast("int")
    placed = ids.withColumn("lane", lane).withColumn("place", F.row_number().over(Window.partitionBy("lane").orderBy("id")) - 1)
    return placed.select("id", (F.col("lane") % side).alias("block"), (F.col("place") * LANES + F.floor(F.col("lane") / side)).cast("int").alias("at"))


def _placed(calls: DataFrame, nodes: DataFrame, side: int) -> DataFrame:
    """row, col, src, dst: a call's cell and its ends' numbers. One to no method has -1 and any cell of its row, since it counts for its start's out-degree; one from no method has no row."""
    start = nodes.select(F.col("id").alias("src"), F.col("block").alias("row"), F.col("at").alias("from"))
    end = nodes.select(F.col("id").alias("dst"), F.col("block").alias("col"), F.col("at").alias("to"))
    met = calls.join(start, "src").select("dst", "row", "from").join(end, "dst", "left")
    return met.select("row", F.coalesce("col", F.pmod("from", F.lit(side))).alias("col"), F.col("from").alias("src"), F.coalesce("to", F.lit(-1)).alias("dst"))


def _cell(size: int):
    """A cell's calls, in order of their ends, up to SLICE of them a row, and in its first row how many calls each start has."""

    def run(t: pa.Table) -> pa.Table:
        row, col = t.column("row")[0].as_py(), t.column("col")[0].as_py()
        src, dst = t.column("src").to_numpy(), t.column("dst").to_numpy()
        degrees = np.bincount(src, minlength=size).astype(np.int32).tobytes()
        order = np.sort(dst[dst >= 0].astype(np.int64) << 32 | src[dst >= 0])
        out = [(row, col, (part & 0xFFFFFFFF).astype(np.int32).tobytes(), (part >> 32).astype(np.int32).tobytes(), None if i else degrees) for i, part in enumerate(np.split(order, range(SLICE, len(order), SLICE)))]
        return pa.table(list(zip(*out, strict=True)), pa.schema([("row", pa.int32()), ("col", pa.int32()), ("src", pa.binary()), ("dst", pa.binary()), ("degrees", pa.binary())]))

    return run


def _degrees(size: int):
    """A block's out-degrees, of those that its cells count."""

    def run(t: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int32)
        for x in t.column("degrees").drop_null():
            total += np.frombuffer(x.as_buffer(), np.int32)
        return pa.table({"block": t.column("row").slice(0, 1), "degrees": [total.tobytes()]})

    return run


def _given(size: int, damping: float, shared: bool):
    """A block's ranks from what its column's cells give; shared: over their out-degrees, as the next round sends them; else by lane."""

    def run(degrees: pa.Table, sums: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in sums.sort_by("row").column("given"):
            total += np.frombuffer(x.as_buffer())
        rank = 1.0 - damping + damping * total
        if shared:
            calls = np.frombuffer(degrees.column("degrees")[0].as_buffer(), np.int32)
            rank = np.divide(rank, calls, out=np.zeros(size), where=calls > 0)
        lanes = 1 if shared else LANES
        block = pa.array(degrees.column("block").to_pylist() * lanes, pa.int32())
        return pa.table({"block": block, "lane": pa.array(range(lanes), pa.int32()), "rank": [rank[k::lanes].tobytes() for k in range(lanes)]})

    return run


def _sums(size: int):
    """What a cell's calls give to each method of its column."""

    def run(cell: pa.Table, sent: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return pa.table([[], [], []], pa.schema([("block", pa.int32()), ("row", pa.int32()), ("given", pa.binary())]))
        share, total = np.frombuffer(sent.column("rank")[0].as_buffer()), np.zeros(size)
        for src, dst in zip(cell.column("src"), cell.column("dst"), strict=True):
            total += np.bincount(np.frombuffer(dst.as_buffer(), np.int32), share[np.frombuffer(src.as_buffer(), np.int32)], size)
        return pa.table({"block": cell.column("col").slice(0, 1), "row": cell.column("row").slice(0, 1), "given": [total.tobytes()]})

    return run


def _ranked(nodes: pa.Table, ranks: pa.Table) -> pa.Table:
    if not nodes.num_rows:
        return pa.table({"id": nodes.column("id"), "pagerank": pa.array([], pa.float64())})
    return pa.table({"id": nodes.column("id"), "pagerank": np.frombuffer(ranks.column("rank")[0].as_buffer())[nodes.column("place").to_numpy()]})


def reach(starts: DataFrame, edges: DataFrame, depth: int, backwards: bool = True) -> DataFrame:
    """Nodes that CALLS edges connect with each start (start, node) in 1 to depth steps: start, node, hop (the fewest steps)."""
    words = _words(starts)
    bit = lambda c: F.expr(f"shiftrightunsigned({c}, place) & 1L")
    marked = _walks(starts, words, edges, depth, backwards).join(words, "word").select("node", "hop", "mask", F.posexplode("names").alias("place", "start"))
    return marked.where(bit("mask") == 1).select("start", "node", "hop")


def _words(starts: DataFrame) -> DataFrame:
    """word, names: the starts, up to WORD of them in a word; a start's place in the array is its bit in the word."""
    own = starts.select("start").distinct()
    count = max(-(-own.count() // WORD), 1)
    dealt = own.withColumn("deal", F.pmod(F.xxhash64("start"), F.lit(count)))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("deal").orderBy("start")) - 1)
    word = F.col("deal") + F.lit(count) * F.floor(F.col("place") / WORD)
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "start"))), lambda x: x["start"])
    return checkpointed(placed.groupBy(word.alias("word")).agg(names.alias("names")), "words")


def _walks(starts: DataFrame, words: DataFrame, edges: DataFrame, depth: int, backwards: bool) -> DataFrame:
    """word, node, hop, mask: the bits of the starts of a word that reach the node in hop steps and no fewer.

    Breadth first, all starts of a word at once: each round joins the last round's nodes with the edges, which stay partitioned by
    the end they are met at, and takes from a node's bits those that it had; each round's nodes are written. So a round shuffles
    a row an edge and word at most, not one an edge and start, and repeated edges change nothing.
    """
    calls = edges.where(F.col("edge_type") == CALLS)
    step = calls.select(F.col("dst" if backwards else "src").alias("node"), F.col("src" if backwards else "dst").alias("next")).repartition("node").persist()
    bits = words.select("word", F.posexplode("names").alias("place", "start")).select("word", "start", F.expr("shiftleft(1L, place)").alias("mask"))
    front = starts.select("start", "node").join(bits, "start").groupBy("word", "node").agg(F.bit_or("mask").alias("mask"))
    known = None
    for hop in range(1, depth + 1):
        found = front.join(step, "node").groupBy("word", F.col("next").alias("node")).agg(F.bit_or("mask").alias("mask"))
        if known is not None:
            seen = known.groupBy("word", "node").agg(F.bit_or("mask").alias("seen"))
            found = found.join(seen, ["word", "node"], "left").select("word", "node", F.expr("mask & ~coalesce(seen, 0L)").alias("mask")).where("mask <> 0")
        front = checkpointed(found, "reach")
        level = front.withColumn("hop", F.lit(hop))
        known = level if known is None else known.unionByName(level)
    step.unpersist()
    return known


def impact(targets: DataFrame, methods: DataFrame, edges: DataFrame, ranks: DataFrame, depth: int = 3, most: int = 100) -> DataFrame:
    """RET-15, JOIN-11: callers that a change of each target (target) reaches, by hop and PageRank, most at most for a target.

    A target's SQL statement or Java interface counts as target too, at no cost; the target itself is left out.
    """
    depth = min(depth, 5)
    own = targets.select(F.col("target").alias("start"), F.col("target").alias("node")).distinct()
    found = reach(with_peers(own, edges), edges, depth).where("node <> start")
    rows = found.join(methods.withColumnRenamed("id", "node"), "node").join(ranks.withColumnRenamed("id", "node"), "node", "left")
    order = Window.partitionBy("target").orderBy("depth", F.desc("pagerank"), "id")
    rows = rows.select(F.col("start").alias("target"), F.col("node").alias("id"), "name", "class_name", "file_path", node_type(F.col("chunk_type")).alias("node_type"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), F.col("hop").alias("depth"))
    best = checkpointed(rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most), "impact")
    # In-degrees are counted for the rows that stay, from the edges that end there; who asks for none has none counted.
    there = edges.where(F.col("edge_type") == CALLS).join(best.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    counts = there.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    out = best.join(counts, "id", "left").withColumn("in_degree", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("target", "id", "name", "class_name", "file_path", "node_type", "pagerank", "in_degree", "depth", "place")


def with_peers(own: DataFrame, edges: DataFrame) -> DataFrame:
    """The starts (start, node) and, as nodes of the same start, the SQL statements and interfaces that IMPLEMENTS edges link with them."""
    links = edges.where(F.col("edge_type") == IMPLEMENTS)
    # A semi-join with what is known to be small goes below what makes the links, a join does not: only the starts' own are made.
    nodes = checkpointed(own.select("node").distinct(), "starts")
    out = own
    for at, peer in (("src", "dst"), ("dst", "src")):
        few = links.join(nodes.withColumnRenamed("node", at), at, "left_semi")
        out = out.union(own.join(few.select(F.col(at).alias("node"), F.col(peer).alias("peer")), "node").select("start", "peer"))
    return out


def node_type(chunk_type: Column) -> Column:
    """PRJ-3, PRJ-4"""
    return F.when(F.coalesce(chunk_type, F.lit("method")) == "sql", "sql").otherwise("method")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JOIN-12: CALLS and IMPLEMENTS edges with both ends among nodes (group, id)."""
    some = edges.where(F.col("edge_type").isin(CALLS, IMPLEMENTS))
    # Semi-joins go below what makes the edges: those of other nodes are not made.
    for end in ("src", "dst"):
        some = some.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return some.join(nodes.select("group", F.col("id").alias("src")), "src").join(nodes.select("group", F.col("id").alias("dst")), ["group", "dst"]).select("group", "src", "dst", "edge_type", "confidence", "call_count").distinct()


def neighbourhood(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """JOIN-16, FIL-14: start, node, hop of everything within depth steps in either direction, the start itself at 0."""
    calls = edges.where(F.col("edge_type") == CALLS)
    both = calls.select("src", "dst").union(calls.select(F.col("dst"), F.col("src"))).withColumn("edge_type", F.lit(CALLS))
    own = starts.select("start", F.col("start").alias("node")).distinct()
    found = reach(own, both, min(max(depth, 1), 5)).where("node <> start")
    return own.withColumn("hop", F.lit(0)).unionByName(found)


def class_graph(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """JOIN-17: calls between classes: from_class, to_class, number of edges and of calls; calls within a class are left out."""
    classes = methods.where(F.coalesce("class_name", F.lit("")) != "").select("id", "class_name")
    calls = edges.where(F.col("edge_type") == CALLS)
    joined = calls.join(classes.select(F.col("id").alias("src"), F.col("class_name").alias("from_class")), "src").join(classes.select(F.col("id").alias("dst"), F.col("class_name").alias("to_class")), "dst")
    return joined.where("from_class <> to_class").groupBy("from_class", "to_class").agg(F.count("*").alias("n_edges"), F.sum("call_count").alias("n_calls"))


def call_paths(pairs: DataFrame, edges: DataFrame, longest: int = 6) -> DataFrame:
    """JOIN-18: shortest call path of each pair (from_id, to_id): nodes (of equal paths the smallest), path_length, found.

    Walks go half of the way from each start and half of the way back from each end, and meet: a path that is no longer than the
    first half meets at its end, a longer one where the first half ends.
    """
    step = checkpointed(edges.where(F.col("edge_type") == CALLS).select("src", "dst").distinct(), "call-edges")
    pairs = pairs.select("from_id", "to_id").distinct()
    half = -(-longest // 2)
    ahead = _smallest_walks(pairs.select(F.col("from_id").alias("start")), step.toDF("at", "next"), half, True)
    back = _smallest_walks(pairs.select(F.col("to_id").alias("start")), step.select(F.col("dst").alias("at"), F.col("src").alias("next")), longest - half, False)
    met = pairs.join(ahead.select(F.col("start").alias("from_id"), "at", F.col("hop").alias("gone"), F.col("path").alias("head")), "from_id").join(back.select(F.col("start").alias("to_id"), "at", F.col("hop").alias("left"), F.col("path").alias("tail")), ["to_id", "at"])
    whole = F.struct((F.col("gone") + F.col("left")).alias("length"), F.concat("head", F.slice("tail", 2, longest + 1)).alias("path"))
    best = met.where((F.col("left") == 0) | (F.col("gone") == half)).groupBy("from_id", "to_id").agg(F.min(whole)["path"].alias("path"))
    out = pairs.join(best, ["from_id", "to_id"], "left")
    return out.select("from_id", "to_id", "path", F.when(F.col("path").isNotNull(), F.size("path") - 1).alias("path_length"), F.col("path").isNotNull().alias("found"))


def _smallest_walks(starts: DataFrame, step: DataFrame, depth: int, ahead: bool) -> DataFrame:
    """start, at, hop, path: nodes within depth steps (at, next) of each start, the fewest steps, and the smallest path of that length, which runs to the node if ahead, else from it."""
    starts = starts.distinct()
    front = starts.select("start", F.col("start").alias("at"), F.array("start").alias("path"))
    known = front.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        path = F.concat("path", F.array("next")) if ahead else F.concat(F.array("next"), "path")
        found = front.join(step, "at").groupBy("start", F.col("next").alias("at")).agg(F.min(path).alias("path"))
        front = checkpointed(found.join(known.select("start", "at"), ["start", "at"], "left_anti"), "paths")
        known = known.unionByName(front.withColumn("hop", F.lit(hop)))
    return known


def call_chain(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """JOIN-8: callers and callees of every method, one hop, as sorted arrays of names; each side is gathered by itself."""
    calls = edges.where(F.col("edge_type") == CALLS)
    label = methods.select("id", F.struct("name", "class_name", "file_path", "signature").alias("other"))
    callers = calls.join(label.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("other")).alias("callers"))
    callees = calls.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("other")).alias("callees"))
    empty = F.array().cast("array<struct<name:string,class_name:string,file_path:string,signature:string>>")
    return methods.join(callers, "id", "left").join(callees, "id", "left").withColumns({"callers": F.coalesce("callers", empty), "callees": F.coalesce("callees", empty)})


def call_context(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """JOIN-10, AGG-11, FIL-12: up to three distinct callers and five callees of every method, those without name dropped after the cut."""
    named = lambda c, n: F.filter(F.slice(c, 1, n), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    return call_chain(methods, edges).withColumns({"callers": named(F.col("callers"), 3), "callees": named(F.col("callees"), 5)})


def layers(nodes: DataFrame, edges: DataFrame, centres: DataFrame, depth: int = 5) -> DataFrame:
    """RET-18: layer of each node around each centre: steps of calls from it (positive), else to it (negative), 0 for itself and what is not reached."""
    starts = centres.select(F.col("centre").alias("start"), F.col("centre").alias("node")).distinct()
    words = _words(starts)
    edges = checkpointed(edges.where(F.col("edge_type") == CALLS).select("src", "dst", "edge_type"), "calls")
    walks = _walks(starts, words, edges, depth, backwards=False).unionByName(_walks(starts, words, edges, depth, backwards=True).withColumn("hop", -F.col("hop")))
    # The order of the steps: down before up, few before many.
    steps = [*range(1, depth + 1), *range(-1, -depth - 1, -1)]
    marks = walks.groupBy("word", "node").agg(*[F.bit_or(F.when(F.col("hop") == h, F.col("mask"))).alias(f"mask{i}") for i, h in enumerate(steps)])
    # Every (centre, node) pair is the result asked for: a node's row stands for all centres of a word until the last step.
    rows = nodes.select(F.col("id").alias("node")).distinct().crossJoin(words).join(marks, ["word", "node"], "left")
    pairs = rows.select("node", *[f"mask{i}" for i in range(len(steps))], F.posexplode("names").alias("place", "centre"))
    layer = F.when(F.col("centre") == F.col("node"), 0)
    for i, h in enumerate(steps):
        layer = layer.when(F.expr(f"shiftrightunsigned(mask{i}, place) & 1L") == 1, h)
    return pairs.select("centre", "node", layer.otherwise(0).alias("layer"))
