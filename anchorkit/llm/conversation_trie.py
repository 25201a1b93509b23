"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt by ranges of their ids and taken in blocks of bounded size. A block is turned
on its side: every (position, turn) has a bitset of the block's conversations that have this turn at
this position. The trie of the block is walked depth first: a node is the bitset of its members, and
its children are intersections of that bitset with postings of the next position. Only postings that
meet the node are touched, as each child is found from the first member not yet in one. Members that
no posting takes end in the node.

Nodes of all blocks are merged by the digest of their path. What a node sums over its subtree needs
every node of the whole trie once: it counts in the block that has its smallest member, is summed over
ranges of the walk inside each block, and added up over blocks. So no round depends on the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorkit.llm.rows import named
from anchorkit.operators.joins import balanced_join
from anchorkit.session import staged

#: A block ends with the conversation that reaches either bound.
BLOCK_CONVERSATIONS, BLOCK_TURNS = 2048, 65_536
PATH, UP = ["path_a", "path_b"], ["up_a", "up_b"]
_LOCAL = ("block long, place int, span int, depth int, path_a long, path_b long, up_a long, up_b long, "
          "owner long, members long, size long, ends array<long>")
_KINDS = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
_LOCAL_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in _LOCAL.split(", "))])


def turn_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Table (conv_id, position, key, size): turns numbered from 1, the digest of (role, text) and the text's code points.

    Turns are ordered by ``turn`` (null first), then role, then the digest of role and text. Null
    roles and texts are empty; repeated rows are turns of their own. Rows without a conversation
    (null) are left out.
    """
    said = [F.coalesce(named(df, c).cast("string"), F.lit("")) for c in (role, text)]
    key = F.unhex(F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said)))
    rows = df.select(named(df, conv).cast("long").alias("conv_id"), named(df, turn).alias("turn"), said[0].alias("role"),
                     key.alias("key"), F.length(said[1]).cast("long").alias("size")).where("conv_id is not null")
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    return rows.select("conv_id", F.row_number().over(order).alias("position"), "key", "size")


def with_roots(turns: DataFrame) -> DataFrame:
    """``turns`` plus one row per conversation at position 0, which keeps conversations without turns."""
    ids = turns.select("conv_id").distinct()
    return turns.union(ids.select("conv_id", F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long")))


def _path(parent: tuple[int, int], key: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(parent[0].to_bytes(8, "little", signed=True) + parent[1].to_bytes(8, "little", signed=True) + key,
                             digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def walk(ids: list[int], turns: list[list[int]], keys: list[bytes], sizes: list[int]) -> list[list]:
    """Nodes of a block in the order of the walk, as columns of ``_LOCAL`` after ``block`` and ``place``.

    ``ids`` ascend; ``turns`` has a conversation's turns as numbers into ``keys`` and ``sizes``.
    """
    postings: list[dict[int, int]] = [{} for _ in range(max(map(len, turns), default=0))]
    for i, said in enumerate(turns):
        for at, turn in enumerate(said):
            postings[at][turn] = postings[at].get(turn, 0) | 1 << i
    nodes: list[list] = []
    todo = [(0, (1 << len(ids)) - 1, (0, 0), (0, 0), 0)]
    while todo:
        depth, members, path, up, size = todo.pop()
        first = (members & -members).bit_length() - 1
        node = [1, depth, *path, *up, ids[first], members.bit_count(), size, []]
        nodes.append(node)
        rest, below = members, []
        while rest:
            low = rest & -rest
            at = low.bit_length() - 1
            if len(turns[at]) == depth:
                node[-1].append(ids[at])
                rest ^= low
                continue
            turn = turns[at][depth]
            child = rest & postings[depth][turn]
            rest ^= child
            below.append((depth + 1, child, _path(path, keys[turn]), path, sizes[turn]))
        todo.extend(reversed(below))
    open_: list[int] = []
    for place, node in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] >= node[1]:
            above = open_.pop()
            nodes[above][0] = place - above
        open_.append(place)
    for place in open_:
        nodes[place][0] = len(nodes) - place
    return nodes


def _block_tries(most_convs: int, most_turns: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of blocks of conversations that come in order of (conv_id, position)."""
    ids: list[int] = []
    turns: list[list[int]] = []
    number: dict[bytes, int] = {}
    sizes: list[int] = []
    held = 0

    def block() -> pa.RecordBatch:
        nodes = walk(ids, turns, list(number), sizes)
        columns = [[ids[0]] * len(nodes), list(range(len(nodes))), *map(list, zip(*nodes))]
        columns[-1] = [x or None for x in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LOCAL_SCHEMA)], schema=_LOCAL_SCHEMA)

    for batch in batches:
        for conv, key, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "size"))):
            if not ids or conv != ids[-1]:
                if len(ids) >= most_convs or held >= most_turns:
                    yield block()
                    ids, turns, number, sizes, held = [], [], {}, [], 0
                ids.append(conv)
                turns.append([])
            if key is not None:
                if key not in number:
                    number[key] = len(number)
                    sizes.append(size)
                turns[-1].append(number[key])
                held += 1
    if ids:
        yield block()


def _subtree_sums(block: pa.Table) -> pa.Table:
    """Leaves and costs below each node of one block's walk, as far as they count in this block."""
    block = block.sort_by("place")
    span = block.column("span").to_numpy()
    at = np.arange(len(span))
    out = {c: block.column(c) for c in PATH}
    for c in ("leaf", "cost"):
        upto = np.concatenate([[0], np.cumsum(block.column(c).to_numpy(), dtype=np.int64)])
        out[c] = pa.array(upto[at + span] - upto[at])
    return pa.table(out)


def prefix_trie(turns: DataFrame, block_conversations: int = BLOCK_CONVERSATIONS, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of ``turns`` (conv_id, position, key, size) and the conversations that end in them.

    ``turns`` has every conversation's turns at positions 1, 2, ... and one row at position 0
    (:func:`with_roots`). Nodes: ``path_a``, ``path_b`` (digest of the path), ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved`` (sum over the
    subtree of (members - 1) * size). Ends: ``path_a``, ``path_b``, ``block``, ``conv_ids`` (ascending; blocks
    ascend too), rows only for nodes in which a conversation ends. No conversation, no node. The
    turns of one conversation are held by one task.
    """
    dealt = turns.select("conv_id", "position", "key", "size").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "position")
    local = staged(dealt.mapInArrow(partial(_block_tries, block_conversations, block_turns), _LOCAL), "trie-blocks")
    merged = local.groupBy(*PATH).agg(
        F.min("owner").alias("conv_id"), F.max("depth").alias("depth"), F.sum("members").alias("n_convs"),
        F.max("size").alias("size"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"))
    merged = staged(merged, "trie-merged")
    above = merged.where("depth > 0")
    kids = above.groupBy(F.col("up_a").alias("path_a"), F.col("up_b").alias("path_b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(kids, PATH, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = staged(nodes, "trie-nodes")
    facts = nodes.select(*PATH, F.col("conv_id").alias("first"), (F.col("n_children") == 0).alias("childless"),
                         ((F.col("n_convs") - 1) * F.col("size")).alias("cost"))
    counts = balanced_join(local.select("block", "place", "span", "owner", *PATH), facts, PATH)
    here = (F.col("owner") == F.col("first"))
    counts = counts.select("block", "place", "span", *PATH, (here & F.col("childless")).cast("long").alias("leaf"),
                           F.when(here, F.col("cost")).otherwise(F.lit(0)).cast("long").alias("cost"))
    sums = counts.groupBy("block").applyInArrow(_subtree_sums, "path_a long, path_b long, leaf long, cost long")
    sums = sums.groupBy(*PATH).agg(F.sum("leaf").alias("n_leaves"), F.sum("cost").alias("saved"))
    parents = nodes.where("n_children > 0").select(F.col("path_a").alias("up_a"), F.col("path_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    placed = balanced_join(above.select(*PATH, *UP), parents, UP).select(*PATH, "parent_conv_id")
    out = nodes.join(sums, PATH).join(placed, PATH, "left")
    ends = local.where("ends is not null").select(*PATH, "block", F.col("ends").alias("conv_ids"))
    return out.select(*PATH, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"), ends


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      **blocks: int) -> tuple[DataFrame, DataFrame]:
    """:func:`prefix_trie` of a table of turns; see :func:`turn_rows` for nulls, ties and repeated rows.

    Other columns are ignored, whatever their names. An empty table has no node.
    """
    return prefix_trie(with_roots(staged(turn_rows(df, conv, turn, role, text), "trie-turns")), **blocks)


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's conversation ids, of rows that come in order of (path, block)."""
    path, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*PATH, "conv_ids"))):
            text = ",".join(map(str, ids)).encode()
            if (a, b) == path:
                state.update(b"," + text)
                continue
            if path is not None:
                done.append((*path, state.hexdigest()))
            path, state = (a, b), hashlib.sha256(text)
        yield _digest_rows(done)
    if path is not None:
        yield _digest_rows([(*path, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*PATH, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(path_a, path_b, ends_sha256): lowercase SHA-256 of the decimal ids, ascending, joined by commas.

    A list is read as a stream of its blocks, so a node in which a third of all conversations end is
    never held whole.
    """
    ordered = ends.repartition(*[F.col(c) for c in PATH]).sortWithinPartitions(*PATH, "block")
    return ordered.mapInArrow(_list_digests, "path_a long, path_b long, ends_sha256 string")


def shared_starts(turns: DataFrame, base: Column, turns_from_base: Column, most: int) -> DataFrame:
    """``turns`` (conv_id, position, key, size, without roots) rebuilt, with roots.

    A conversation becomes the first ``turns_from_base`` (at most ``most``) turns of the conversation
    ``base`` (all if it has fewer, none if it isn't there), then its own turns after its first
    ``turns_from_base``. Both are columns computed from ``conv_id``.
    """
    rows = turns.withColumns({"base": base, "h": turns_from_base.cast("int")})
    firsts = rows.where((F.col("conv_id") == F.col("base")) & (F.col("position") <= most)).groupBy("base").agg(
        F.sort_array(F.collect_list(F.struct("position", "key", "size"))).alias("firsts"))
    firsts = staged(firsts, "trie-firsts")
    ids = rows.select("conv_id", "base", "h").distinct()
    lead = balanced_join(ids, firsts, ["base"]).select("conv_id", F.inline(F.slice("firsts", F.lit(1), F.col("h"))))
    kept = F.least(F.col("h"), F.coalesce("held", F.lit(0)))
    own = balanced_join(rows.where("position > h"), firsts.select("base", F.size("firsts").alias("held")), ["base"], "left").select(
        "conv_id", (kept + F.col("position") - F.col("h")).alias("position"), "key", "size")
    roots = ids.select("conv_id", F.lit(0).alias("position"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("size"))
    return lead.unionByName(own).unionByName(roots)
