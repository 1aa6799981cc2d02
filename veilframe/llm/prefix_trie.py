"""Conversations that begin alike share the nodes of a trie; built with vertical bitmaps, shard by shard.

A shard holds a few thousand conversations. For each position and turn it indexes the conversations that have this
turn at this position as a bitset, and walks depth-first: a node's bitset met with a posting of the next position is a child's
bitset. Its bits counted are the child's conversations, its lowest bit the smallest of them, and the bits of those that stop
there its list of ends. Shards are ranges of ids, so hot beginnings are spread over all shards and arrive as one row for each
shard; nodes of equal paths are then added up.

Sums over subtrees need no walk across shards. Each node is owned by its smallest conversation, which owns a stretch of
nodes down to its own end. Once that is known, a second walk counts, for each node, the members that own a childless node, and
the words of turns that members have in common with an owner: summed over shards these are the leaves and the savings.

Long conversations are cut into blocks of ``BLOCK`` turns. A block is a member of shards of its own, with the path before
it as posting of position 0, so no task needs a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordered import numbered
from .common import materialize, q, text_or_empty, word_count

BLOCK = 4096            # turns of a conversation that a shard takes at once
SHARD_MEMBERS = 4096    # conversations of a shard …
SHARD_TURNS = 1 << 17   # … and turns
SHARED = 3              # turns that a rebuilt conversation may take from its group's first
GROUP = 20
NEVER = 1 << 62
ROOT = b""


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


class Member(NamedTuple):
    """A block of a conversation. ``last``: it ends here. The rest is known in the second walk only."""
    conv: int
    start: bytes            # key of the path before the block
    turns: list[bytes]
    words: list[int]
    last: bool
    owns_from: int = NEVER  # depth from which it owns nodes
    leaf: bool = False      # whether it owns a childless node
    later: int = 0          # words of its later blocks that it does not own


class Node(NamedTuple):
    key: bytes
    parent: int             # place of the parent in the walk, -1 for none
    parent_key: bytes | None
    level: int              # turns of the block that lead here
    members: int            # a bitset
    words: int              # of the last turn


class Shard:
    """Postings of some members, in ascending order of conversations, of the same block."""

    def __init__(self, members: list[Member]) -> None:
        self.members = members
        longest = max(len(m.turns) for m in members)
        self.starts: dict[bytes, int] = {}
        self.postings: list[dict[bytes, int]] = [{} for _ in range(longest)]
        self.longer = [0] * (longest + 1)       # members with more turns than the level
        self.ended = [0] * (longest + 1)        # members whose conversation ends at the level
        for k, m in enumerate(members):
            bit = 1 << k
            self.starts[m.start] = self.starts.get(m.start, 0) | bit
            for level, turn in enumerate(m.turns):
                held = self.postings[level]
                held[turn] = held.get(turn, 0) | bit
                self.longer[level] |= bit
            if m.last:
                self.ended[len(m.turns)] |= bit

    def walk(self) -> Iterator[Node]:
        """Nodes depth-first, parents before children; first the nodes that the block hangs from, at level 0."""
        place = -1
        for start, members in self.starts.items():
            todo = [(Node(start, -1, None, 0, members, 0), b"")]
            while todo:
                node, chain = todo.pop()
                place += 1
                yield node
                level, rest = node.level, node.members & self.longer[node.level]
                if not rest:
                    continue
                held = self.postings[level]
                while rest:
                    first = self.members[(rest & -rest).bit_length() - 1]
                    turn = first.turns[level]
                    child = rest & held[turn]
                    rest ^= child
                    path = _digest(chain, turn)
                    todo.append((Node(_digest(b"node", start, path), place, node.key, level + 1, child, first.words[level]), path))

    def smallest(self, members: int) -> int:
        return self.members[(members & -members).bit_length() - 1].conv

    def each(self, members: int) -> Iterator[Member]:
        while members:
            low = members & -members
            yield self.members[low.bit_length() - 1]
            members ^= low


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    """Members as they come, sorted by block and conversation within a range of ids, gathered into shards: ``(block, Shard)``."""
    held: list[Member] = []
    at, turns = None, 0
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            where, member = (r[0], r[1]), Member(*r[2:])
            if held and (where != at or len(held) >= SHARD_MEMBERS or turns + len(member.turns) > SHARD_TURNS):
                yield at[1], Shard(held)
                held, turns = [], 0
            at = where
            held.append(member)
            turns += len(member.turns)
    if held:
        yield at[1], Shard(held)


_FIRST = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()),
                    ("n_ends", pa.int64()), ("first_end", pa.int64()), ("ends", pa.string())])
_SECOND = pa.schema([("key", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64())])


def _rows(kind: pa.Schema, rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in kind]
    for row in rows:
        for column, value in zip(out, row):
            column.append(value)
        if len(out[0]) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)
            out = [[] for _ in kind]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)


def _find_nodes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """First walk: what a shard knows of each node."""

    def rows() -> Iterator[tuple]:
        for block, shard in _shards(batches):
            for node in shard.walk():
                if node.level == 0 and block:
                    continue    # the last node of the block before
                ends = [m.conv for m in shard.each(node.members & shard.ended[node.level])]
                yield (node.key, node.parent_key, block * size + node.level, shard.smallest(node.members), node.members.bit_count(),
                       len(ends), ends[0] if ends else None, ",".join(map(str, ends)) if ends else None)

    return _rows(_FIRST, rows())


def _sum_subtrees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Second walk: leaves and savings of a shard's members below each node."""

    def rows() -> Iterator[tuple]:
        for block, shard in _shards(batches):
            leaf = sum(1 << k for k, m in enumerate(shard.members) if m.leaf)
            shared = [0] * len(shard.longer)    # members that do not own the node of the level
            for k, m in enumerate(shard.members):
                for level in range(min(len(m.turns) + 1, max(0, m.owns_from - block * size))):
                    shared[level] |= 1 << k
            nodes = list(shard.walk())
            saved = [(n.members & shared[n.level]).bit_count() * n.words for n in nodes]
            for k, n in enumerate(nodes):
                if n.level == size:
                    saved[k] += sum(m.later for m in shard.each(n.members & ~shard.ended[size]))
            for k in range(len(nodes) - 1, -1, -1):
                if nodes[k].parent >= 0:
                    saved[nodes[k].parent] += saved[k]
            for n, total in zip(nodes, saved):
                if n.level or not block:
                    yield n.key, (n.members & leaf).bit_count(), total

    return _rows(_SECOND, rows())


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the list of ends, sorted by node and id, to the digest of each node's whole list."""

    def rows() -> Iterator[tuple]:
        key, running = None, None
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        yield key, running.hexdigest()
                    key, running = k, hashlib.sha256(text.encode())
                else:
                    running.update(f",{text}".encode())
        if key is not None:
            yield key, running.hexdigest()

    return _rows(pa.schema([("key", pa.binary()), ("sha", pa.string())]), rows())


def _block_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the path through each block, as ``Shard.walk`` chains it."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for conv, block, turns in zip(*(batch.column(k).to_pylist() for k in range(3))):
                path = b""
                for turn in turns:
                    path = _digest(path, turn)
                yield conv, block, path

    return _rows(pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("path", pa.binary())]), rows())


def _chain_blocks(table: pa.Table) -> pa.Table:
    """Of one long conversation, a row for each block: the key of the path before it."""
    table = table.sort_by("block")
    start, starts = ROOT, []
    for path in table["path"].to_pylist():
        starts.append(start)
        start = _digest(b"node", start, path)
    return pa.table({"conv": table["conv"], "block": table["block"], "start": pa.array(starts, pa.binary())})


def turn_digest(role_col: str, text_col: str) -> Column:
    """16 bytes of the SHA-256 of role and text; the role's length keeps them apart."""
    role = text_or_empty(role_col)
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text_or_empty(text_col)).cast("binary"), 256)), 1, 16)


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, depth, digest, words, length)``: the turns of every rebuilt conversation, and a row of depth 0 for each.

    A conversation takes the first ``h`` turns of its group's first conversation, and its own after its first ``h``;
    ``h`` is the CRC-32 of its id modulo ``SHARED + 1``.
    """
    read = turns.where(q(conv_col).isNotNull()).select(
        q(conv_col).cast("long").alias("conv"), q(turn_col).alias("turn"), turn_digest(role_col, text_col).alias("digest"),
        word_count(text_col).alias("words"))
    own = numbered(read, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")], "place").select("conv", "place", "digest", "words")
    own = materialize(own, "turns")
    heads = own.where((F.col("conv") % GROUP == 0) & (F.col("place") <= SHARED)).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head")).withColumnRenamed("conv", "base")
    info = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "base": F.col("conv") - F.col("conv") % GROUP, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % (SHARED + 1)})
    info = info.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("h").cast("int")))
    info = materialize(info.select("conv", "h", "head", F.size("head").alias("taken"),
                                   (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "rebuilt")
    mine = own.join(info.select("conv", "h", "taken", "length"), "conv").where(F.col("place") > F.col("h")).select(
        "conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words", "length")
    taken = info.select("conv", "length", F.explode("head").alias("t")).select("conv", F.col("t.place").alias("depth"), "t.digest", "t.words", "length")
    none = info.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"), "length")
    return mine.unionByName(taken).unionByName(none)


def _members(turns: DataFrame, size: int) -> DataFrame:
    """``(shard, block, conv, start, turns, words, last)``: blocks of conversations in ranges of ids, sorted."""
    block = F.floor(F.greatest(F.lit(0), F.col("depth") - 1) / size)
    cut = (turns.withColumn("block", block).repartition("conv", "block").groupBy("conv", "block")
           .agg(F.filter(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))), lambda t: t["depth"] > 0).alias("t"),
                F.max("length").alias("length"))
           .select("conv", "block", F.col("t.digest").alias("turns"), F.col("t.words").alias("words"), "length",
                   (F.col("block") == F.floor(F.greatest(F.lit(0), F.col("length") - 1) / size)).alias("last")))
    cut = materialize(cut, "blocks")
    starts = (cut.where(F.col("length") > size).select("conv", "block", "turns").mapInArrow(_block_paths, "conv long, block long, path binary")
              .groupBy("conv").applyInArrow(_chain_blocks, "conv long, block long, start binary"))  # a row for each block of a conversation
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut.join(starts, ["conv", "block"], "left").repartitionByRange(parts, "block", "conv").sortWithinPartitions("block", "conv")
    return materialize(ranged.select(F.spark_partition_id().alias("shard"), "block", "conv", F.coalesce("start", F.lit(ROOT)).alias("start"),
                                     "turns", "words", "last"), "members")


def _with_owners(members: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``members`` with what the second walk needs; sorted as before."""
    owners = nodes.groupBy("conv").agg(F.min("depth").alias("owns_from"), F.max(F.col("n") == F.col("n_ends")).alias("leaf"))
    known = members.join(owners, "conv", "left").withColumns({"owns_from": F.coalesce("owns_from", F.lit(NEVER)), "leaf": F.coalesce("leaf", F.lit(False))})
    before = F.least(F.size("words").cast("long"), F.greatest(F.lit(0), F.col("owns_from") - F.col("block") * size - 1)).cast("int")
    unowned = F.aggregate(F.slice("words", F.lit(1), before), F.lit(0).cast("long"), lambda a, x: a + x)
    after = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    later = known.withColumn("later", F.coalesce(F.sum(unowned).over(after), F.lit(0)))
    return later.repartition("shard").sortWithinPartitions("shard", "block", "conv").select(
        "shard", "block", "conv", "start", "turns", "words", "last", "owns_from", "leaf", "later")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                block: int = BLOCK) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by number, null first; turns of equal numbers (repeated rows, too, each counts) by the digest of role
    and text. Null roles and texts are empty ones. Rows with a null conversation id belong to no conversation and are left out. Without any
    conversation there is no row, not even the root's. Other columns, whatever their names, are not read. Ids are whole numbers.
    """
    members = _members(rebuilt(turns, conv_col, turn_col, role_col, text_col), block)
    first = "key binary, parent binary, depth long, conv long, n long, n_ends long, first_end long, ends string"
    found = materialize(members.mapInArrow(partial(_find_nodes, size=block), first), "found")
    nodes = materialize(found.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"),
        F.sum("n_ends").alias("n_ends")), "nodes")
    sums = _with_owners(members, nodes, block).mapInArrow(partial(_sum_subtrees, size=block), "key binary, leaves long, saved long")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("children"))
    # pieces of a list: one for each shard; only their digest goes on
    ends = (found.where("n_ends > 0").select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end")
            .select("key", "ends").mapInArrow(_hash_ends, "key binary, sha string"))
    none = F.lit(None)
    facts = (sums.select("key", "leaves", "saved", none.cast("long").alias("children"), none.cast("string").alias("sha"))
             .unionByName(children.select("key", none.cast("long").alias("leaves"), none.cast("long").alias("saved"), "children", none.cast("string").alias("sha")))
             .unionByName(ends.select("key", none.cast("long").alias("leaves"), none.cast("long").alias("saved"), none.cast("long").alias("children"), "sha"))
             .groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children"), F.max("sha").alias("sha")))
    root = nodes.where("depth = 0").agg(F.min("conv").alias("conv")).first()["conv"]
    parents = nodes.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    return (nodes.join(facts, "key").join(parents, "parent", "left").select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") == 1, F.lit(root).cast("long")).otherwise(F.col("parent_conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.coalesce("children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
