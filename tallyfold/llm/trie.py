"""Operator 11: the trie of conversation prefixes, summed over subtrees by heavy-path decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns or nodes of one conversation or path that are summed in one piece; sums of pieces are added before.
BLOCK = 4096
#: Conversations are rebuilt on one of so many, and take less than LEADS turns of it.
FAMILY, LEADS = 100, 6
#: Ids in a chunk of a digest's text.
CHUNK = 1 << 16

_KEY = ["depth", "h1", "h2"]


def lead_of(conv: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with, at most: crc32 of its decimal id, modulo LEADS."""
    return (F.crc32(conv.cast("string").cast("binary")) % LEADS).cast("long")


def rebuild(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id; turns: conv_id, pos, g1, g2, chars): conversations as their family's first one and their own id make them.

    Texts are read and sorted once; what is stored is 128 bits of hash and a length for each turn. Rows are range-sorted by conversation and turn, so a
    conversation of a third of all rows lies in many ranges; only a range's first conversation can go on from ranges before, and that
    one's count is added: a row for each range at most.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = df.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("t"), role.alias("r"), text.alias("x"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "t", "r", "x", "row"]
    at = said.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    piece = [F.xxhash64(F.lit(s), F.length("r"), "r", "x").alias(g) for s, g in (("g1", "g1"), ("g2", "g2"))]
    turns = common.keep(at.select("conv_id", F.shiftright("at", 33).alias("range"), "at", *piece, F.length("x").cast("long").alias("chars")), "turns")
    here = turns.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    carry = here.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).filter("before > 0").select("conv_id", "range", "before")
    k = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("at"))
    placed = common.keep(turns.withColumn("k", k).join(F.broadcast(carry), ["conv_id", "range"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "g1", "g2", "chars"), "numbered")
    convs = common.keep(here.select("conv_id").distinct(), "conversations")
    heads = placed.filter((F.col("k") < LEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    lead, base = lead_of(F.col("conv_id")), F.col("conv_id") - F.col("conv_id") % FAMILY
    taken = convs.filter(lead > 0).select("conv_id", base.alias("base"), F.explode(F.sequence(F.lit(1), lead.cast("int"))).alias("k")).join(heads, ["base", "k"])
    lengths = heads.groupBy("base").agg(F.max("k").alias("has"))
    short = convs.select("conv_id", lead.alias("lead"), base.alias("base")).join(lengths, "base", "left").select("conv_id", (F.col("lead") - F.coalesce("has", F.lit(0))).alias("lacks")).filter("lacks > 0")
    own = placed.filter(F.col("k") > lead).join(short, "conv_id", "left").withColumn("pos", F.col("k") - F.coalesce("lacks", F.lit(0)))
    rows = taken.select("conv_id", F.col("k").cast("long").alias("pos"), "g1", "g2", "chars").unionByName(own.select("conv_id", F.col("pos").cast("long"), "g1", "g2", "chars"))
    return convs, common.keep(rows.select("conv_id", "pos", F.xxhash64("pos", "g1").alias("g1"), F.xxhash64("pos", "g2").alias("g2"), "chars"), "rebuilt")


def running(rows: DataFrame, key: str, place: str, what: dict[str, str], fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], longest: int, back: bool = False) -> DataFrame:
    """rows with what[c], the fold of column c over the rows of a key up to this one in order of place (from the last one on, with back).

    Stretches of BLOCK places are folded each by itself; where a key has several, the folds of those before are added, so no key is one task's work. rows is a stored table.
    """
    turn = F.desc if back else F.asc
    rows = rows.withColumn("__block", F.floor(F.col(place) / BLOCK))
    within = Window.partitionBy(key, "__block").orderBy(turn(place)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({o: fold(F.col(c)).over(within) for c, o in what.items()})
    if longest >= BLOCK:
        before = Window.partitionBy(key).orderBy(turn("__block")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy(key, "__block").agg(*[fold(F.col(c)).alias(c) for c in what]).select(key, "__block", *[fold(F.col(c)).over(before).alias(f"__{o}") for c, o in what.items()])
        out = out.join(blocks, [key, "__block"]).withColumns({o: join(F.col(o), F.coalesce(F.col(f"__{o}"), F.lit(0))) for o in what.values()}).drop(*[f"__{o}" for o in what.values()])
    return out.drop("__block")


def _chunks(batches):
    """Consecutive ids of a node as text, in chunks: (h1, h2, depth, first id, text)."""
    node, ids = None, []
    emit = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*node, ids[0])] + [pa.array([",".join(map(str, ids))])], names=["h1", "h2", "depth", "first", "ids"])
    for b in batches:
        made = []
        for *here, conv in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "depth", "conv_id"))):
            if ids and (here != node or len(ids) >= CHUNK):
                made.append(emit())
                ids = []
            node = here
            ids.append(conv)
        if made:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    if ids:
        yield emit()


def _digests(batches):
    """SHA-256 of each node's chunks, read in order as they come."""
    node, sha = None, None
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    for b in batches:
        made = []
        for *here, ids in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "depth", "ids"))):
            if here == node:
                sha.update(b"," + ids.encode())
            else:
                if node:
                    made.append((*node, sha.hexdigest()))
                node, sha = here, hashlib.sha256(ids.encode())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*node, sha.hexdigest()), schema)], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, h1, h2, ends_sha256 of (conv_id, depth, h1, h2), a stored table. A digest reads its text in order, so the last step of a node is one
    task's, but in chunks of text that range-sorted tasks have made; no task holds more than a chunk."""
    order = ["h1", "h2", "depth", "conv_id"]
    cut = common.in_arrow(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), _chunks, "h1 long, h2 long, depth long, first long, ids string", "trie")
    chunks = common.keep(cut, "chunks")
    return common.in_arrow(chunks.repartition(*order[:3]).sortWithinPartitions(*order[:3], "first").select(*order[:3], "ids"), _digests, "h1 long, h2 long, depth long, ends_sha256 string", "trie")


def decompose(convs: DataFrame, prefixes: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, paths). tree: every node, with its parent's conv_id and whether another child of the parent is its heavy one. paths: (rep, level, top, depth,
    h1, h2): every node's heavy path, named by the conversation rep that ends it, with the light edges above it.

    A node's heavy child has the most members (of equals, the smallest conv_id), so a light edge at least halves the members and level is at most their
    logarithm. Every heavy path ends in a childless node, whose least conversation runs through the whole path: its turns from
    its last light node on are the path, and the number of its light nodes is the path's level. So paths need no iteration.
    """
    nodes = prefixes.groupBy(F.col("pos").alias("depth"), "h1", "h2").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    nothing = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(nothing.alias("depth"), nothing.alias("h1"), nothing.alias("h2"), "n_convs", "conv_id", nothing.alias("chars"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = common.keep(nodes.unionByName(root), "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"), "h1", "h2")).alias("heavy"))
    nodes = common.keep(nodes.join(kids, _KEY, "left").select(*nodes.columns, F.coalesce("n_children", nothing).alias("n_children"), F.col("heavy.h1").alias("heavy1"), F.col("heavy.h2").alias("heavy2")), "nodes")
    above = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "heavy1", "heavy2")
    tree = nodes.drop("heavy1", "heavy2").join(above, ["depth", "q1", "q2"], "left").withColumn("light", F.coalesce((F.col("h1") != F.col("heavy1")) | (F.col("h2") != F.col("heavy2")), F.lit(False))).drop("heavy1", "heavy2")
    tree = common.keep(tree, "tree")
    reps = tree.filter("n_children = 0").select("conv_id")
    along = common.keep(prefixes.join(reps, "conv_id", "left_semi").select("conv_id", F.col("pos").alias("depth"), "h1", "h2"), "along")
    light = along.join(tree.filter("light").select(*_KEY), _KEY).groupBy("conv_id").agg(F.max("depth").alias("top"), F.count(F.lit(1)).alias("level"))
    named = common.keep(reps.join(light, "conv_id", "left").select("conv_id", F.coalesce("top", nothing).alias("top"), F.coalesce("level", nothing).alias("level")), "named")
    trunk = named.filter("level = 0").select(F.col("conv_id").alias("rep"), "level", "top", nothing.alias("depth"), nothing.alias("h1"), nothing.alias("h2"))
    return tree, along.join(named, "conv_id").filter("depth >= top").select(F.col("conv_id").alias("rep"), "level", "top", *_KEY).unionByName(trunk)


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of rebuilt conversations.

    Turns are in order of turn (null first), then role, then text; repeated rows are turns of their own. Null roles and texts are empty. Rows without
    conv_id belong to no conversation. A conversation whose rebuilt form has no turn is a member of the root only. An empty table gives no rows.
    Nodes are told apart by depth and 128 bits of hash, a running exclusive-or over turns' hashes, each with its place.

    Subtrees are summed path by path: a path's sums run from its end up, and what a path's top has is added to its parent before the parent's path
    runs, one level of light edges in a round. A round reads only its level's paths, and the levels are at most the logarithm of the conversations.
    """
    convs, rows = rebuild(df, conv_col, turn_col, role_col, text_col)
    longest = rows.agg(F.max("pos")).first()[0] or 0
    xor = lambda a, b: a.bitwiseXOR(b)
    rolled = running(rows, "conv_id", "pos", {"g1": "h1", "g2": "h2"}, F.bit_xor, xor, longest)
    prefixes = common.keep(rolled.select("conv_id", "pos", "h1", "h2", xor(F.col("h1"), F.col("g1")).alias("q1"), xor(F.col("h2"), F.col("g2")).alias("q2"), "chars"), "prefixes")
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(F.col("pos").alias("depth"), "h1", "h2")).alias("x"))
    nothing = F.lit(0).cast("long")
    ends = common.keep(convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"x.{c}", nothing).alias(c) for c in _KEY]), "ends")
    tree, paths = decompose(convs, prefixes, ends)
    own = tree.withColumns({"own_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "own_saved": (F.col("n_convs") - 1) * F.col("chars")})
    paths = common.keep(paths.join(own.drop("chars", "light"), _KEY), "paths", by="level")
    given, done = None, []
    for level in range(paths.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = paths.filter(F.col("level") == level)
        if given is not None:
            here = common.keep(here.join(given, _KEY, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", nothing) for c in ("own_leaves", "own_saved")}).drop("more_own_leaves", "more_own_saved"), "attached")
        summed = running(here, "rep", "depth", {"own_leaves": "n_leaves", "own_saved": "saved_tokens"}, F.sum, lambda a, b: a + b, longest, back=True)
        done.append(common.keep(summed.select(*_KEY, "q1", "q2", "top", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "level"))
        given = done[-1].filter((F.col("depth") == F.col("top")) & (F.col("depth") > 0)).groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.sum("n_leaves").alias("more_own_leaves"), F.sum("saved_tokens").alias("more_own_saved"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    empty = hashlib.sha256(b"").hexdigest()
    return out.join(end_digests(ends), _KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
