"""The trie of conversations' beginnings, by ownership of the smallest member.

A node is a distinct sequence of first turns. The smallest conversation that begins with it owns it; as members of a node are members of all nodes above, a
conversation owns the last part of its own path, from some depth on. So what a subtree holds needs no walk: over the conversations that pass a node, the tokens of all
their further turns, less the tokens of the further nodes they own, are the tokens that sharing saves; a conversation counts as a leaf where it owns its last node
and nothing continues it; and each child counts at the conversation that owns it. All are sums over one group-by of prefixes.

Texts never leave their task: a turn goes on as a digest of its role and text and its length. A prefix is the sum of 128-bit hashes of its turns and their places,
which running sums along a conversation give. No conversation, node or list of members is gathered: windows run along sorted rows, groups are
aggregated before the shuffle, and the members that end at a node are hashed as a stream of sorted chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _SECOND, discard, materialize, operator

#: Conversations that end at one node and go on as one row of their chunk.
CHUNK = 1 << 16


def _halves(seed: int, *of: str) -> tuple[Column, Column]:
    """64 bits as two numbers of 32, whose sums stay within a long."""
    whole = F.xxhash64(F.lit(seed), *of)
    return F.shiftrightunsigned(whole, 32), whole.bitwiseAND(F.lit(0xFFFFFFFF))


def _joined(high: Column, low: Column) -> Column:
    """The 64 bits of two sums, each modulo 2^32."""
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place, digest, tokens): the turns of each conversation, numbered from 1 in their order."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(text_).cast("bigint").alias("tokens"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv", F.row_number().over(order).alias("place"), "digest", "tokens")


def _rebuilt(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv, own, place, digest, tokens) of rebuilt conversations, and a row of place 0 for each: the first turns of the group's first conversation, then the own ones."""
    base = F.col("conv") - F.col("conv") % group
    head = F.when(base == F.col("conv"), F.lit(0)).otherwise(F.crc32(F.col("conv").cast("string")) % heads).cast("int")
    convs = turns.where("place = 1").select("conv", base.alias("base"), head.alias("head"))
    roots = convs.select("conv", F.lit(False).alias("own"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("tokens"))
    first = turns.where((F.col("conv") % group == 0) & (F.col("place") < heads)).select(F.col("conv").alias("base"), "place", "digest", "tokens")
    lent = convs.where("head > 0").join(first, "base").where("place <= head").select("conv", F.lit(False).alias("own"), "place", "digest", "tokens")
    rest = turns.where(F.col("place") > head).select("conv", F.lit(True).alias("own"), "place", "digest", "tokens")
    return roots.union(lent).union(rest)


def _paths(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, a, b, pa, pb, tokens, onward, more): for each node of each path its 128-bit prefix and that of the node above (null at the root), the tokens of
    its last text, those from here to the path's end, and how many turns follow."""
    order = Window.partitionBy("conv").orderBy("own", "place")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("conv")
    rows = rebuilt.withColumn("depth", F.row_number().over(order) - 1)
    parts = [x for seed in (42, _SECOND) for x in _halves(seed, "depth", "digest")]
    rows = rows.select("conv", "own", "place", "depth", "tokens", *[F.when(F.col("depth") == 0, F.lit(0)).otherwise(p).cast("bigint").alias(f"h{i}") for i, p in enumerate(parts)])
    sums = [F.sum(f"h{i}").over(so_far) for i in range(4)]
    rows = rows.select("conv", "own", "place", "depth", "tokens", _joined(sums[0], sums[1]).alias("a"), _joined(sums[2], sums[3]).alias("b"), (F.sum("tokens").over(whole) - F.sum("tokens").over(so_far) + F.col("tokens")).alias("onward"), (F.count("*").over(whole) - 1 - F.col("depth")).alias("more"))
    return rows.select("conv", "depth", "a", "b", F.lag("a").over(order).alias("pa"), F.lag("b").over(order).alias("pb"), "tokens", "onward", "more")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, conv), sorted, to a row for each run of one node: (a, b, least, many, ids), the ids joined by commas."""
    for batch in batches:
        a, b, conv = (batch.column(i).to_numpy() for i in range(3))
        head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
        names = conv.astype(str).tolist()
        ends = np.append(head, len(a))[1:]
        for lo in range(0, len(head), CHUNK):
            own = slice(lo, lo + CHUNK)
            ids = pa.array([",".join(names[i:j]) for i, j in zip(head[own].tolist(), ends[own].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(a[head[own]]), pa.array(b[head[own]]), pa.array(conv[head[own]]), pa.array(ends[own] - head[own]), ids], ["a", "b", "least", "many", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (a, b, least, many, ids) sorted by node and least id to (a, b, ends_sha256): one digest grows along the chunks of a node, which are never held together."""
    now, state = None, None

    def out(nodes, digests):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in nodes], pa.int64()), pa.array([x[1] for x in nodes], pa.int64()), pa.array(digests, pa.string())], ["a", "b", "ends_sha256"])

    for batch in batches:
        nodes, digests = [], []
        for node, ids in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(4), strict=True):
            if node == now:
                state.update(b",")
            else:
                if now is not None:
                    nodes.append(now)
                    digests.append(state.hexdigest())
                now, state = node, sha256()
            state.update(ids.as_buffer())
        if nodes:
            yield out(nodes, digests)
    if now is not None:
        yield out([now], [state.hexdigest()])


@operator
def prefix_trie(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", group: int = 100, heads: int = 6) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id (the parent's smallest member; null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn, null first; rows with equal turns by the sha256 of `<code points of the role>:<role><text>`, so that repeated rows are
    repeated turns. Null roles and texts are empty. Each conversation c is rebuilt: the first h turns of conversation c - c % group (% keeps the sign of c), then its own from the turn after
    its h-th; h is crc32 of c in decimal, modulo heads, and 0 for a group's first conversation, whose turns stay anyway. Nodes are the distinct sequences of first turns,
    the empty one included; a conversation may have no turn left and be a member of the root alone. saved_tokens: over the node's subtree, itself included, each node's
    (n_convs - 1) times the code points of its last text; n_leaves: nodes of the subtree without children. ends_sha256: of the ids that end at the node, ascending in
    decimal, joined by commas. Ids are whole numbers; rows without one belong to no conversation. An empty table gives an empty result; other columns are not looked at.
    """
    turns = materialize(_turns(conversations, conv_column, turn_column, role_column, text_column))
    paths = materialize(_paths(_rebuilt(turns, group, heads)))
    discard(turns)
    key = ["a", "b"]
    nodes = paths.groupBy(*key).agg(F.min("conv").alias("owner"), F.max("depth").alias("depth"), F.max("tokens").alias("tokens"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), (F.max("more") == 0).alias("leaf"))
    nodes = materialize(nodes)
    own = nodes.groupBy("owner").agg(F.min(F.struct("depth", "pa", "pb")).alias("top"), F.sum("tokens").alias("owned"), F.bool_or("leaf").alias("leaf"))
    own = materialize(own.select("owner", F.col("top.depth").alias("since"), F.col("top.pa").alias("pa"), F.col("top.pb").alias("pb"), "owned", "leaf"))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("above"))
    own = materialize(own.join(above, ["pa", "pb"], "left").select(F.col("owner").alias("conv"), "since", "owned", "leaf", "above"))
    passed = paths.join(own, "conv", "left").select(
        *key, "conv", "depth", F.coalesce(F.col("depth") >= F.col("since"), F.lit(False)).alias("owns"), F.when(F.col("depth") == F.col("since"), F.col("above")).when(F.col("depth") > F.col("since"), F.col("conv")).alias("parent"),
        F.when(F.coalesce(F.col("depth") >= F.col("since"), F.lit(False)), 0).otherwise(F.col("onward") - F.coalesce("owned", F.lit(0))).alias("saved"),
        F.coalesce(F.col("leaf"), F.lit(False)).cast("bigint").alias("leaf"), F.coalesce((F.col("more") > 0) & (F.col("depth") + 1 >= F.col("since")), F.lit(False)).cast("bigint").alias("child"),
    )
    trie = passed.groupBy(*key).agg(
        F.min("conv").alias("conv_id"), F.max("depth").cast("bigint").alias("depth"), F.max("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    ends = paths.where("more = 0").select(*key, "conv")
    chunks = materialize(ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(_chunks, "a bigint, b bigint, least bigint, many bigint, ids string"))
    digests = chunks.repartition(*key).sortWithinPartitions(*key, "least").mapInArrow(_digests, "a bigint, b bigint, ends_sha256 string")
    out = trie.join(digests, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    out = materialize(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    for used in (paths, nodes, own, chunks):
        discard(used)
    return out
