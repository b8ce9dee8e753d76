"""Conversation prefix trie by whole sequences: equal conversations become one weighted sequence.

The trie is never walked. Equal rebuilt conversations are grouped into one sequence with a weight and a
list of ends; sequences that are proper prefixes of others go by an anti-join, what stays are the leaves;
and the weighted prefixes of all sequences are summed per node.

A node is known by a digest of its prefix, a chain of SHA-256 over the turns. Chains are computed in pieces of
``PIECE`` turns, then over the pieces, and so on, so one conversation may hold any share of all turns:
no task gathers more than a piece. The sum over a subtree needs no walk either. With n_v
the members of node v and b_v the bytes of its last text, the sum of n_v * b_v below node u is what the
members of u have left from there on, and the sum of b_v takes every node once: at the sequence that holds
its smallest member, which holds all nodes of that kind from some depth on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm.common import col, map_arrow, table
from kveil.operators.project import with_dense_id
from kveil.session import cut_lineage

PIECE = 128  # turns, or pieces of turns, that are chained in one row
RUN = 4096  # conversation ids that are joined into one text before they meet


def sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def root() -> Column:
    """The digest of no turns: one byte, where real digests have 32."""
    return F.unhex(F.lit("00"))


def turns_of(df: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes) of every turn, pos from 0 by turn (null first), ties by digest.

    Numbered over the whole table, so a conversation of any length is spread over many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = df.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        sha(content).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return with_dense_id(rows, ["conv_id", "turn", "digest"], id_col="no")


def rebuilt(df: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, digest, bytes) of the rebuilt conversations, (conv_id, n_turns) of all of them).

    Conversation c begins with the first h turns of conversation c - c % group, all if it has fewer, none
    if there is no such, and goes on with its own turns after its first h; h is crc32(c) % most.
    """
    numbered = turns_of(df)
    sizes = numbered.groupBy("conv_id").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    sizes = cut_lineage(sizes.withColumns({"h": h, "giver": F.col("conv_id") - F.col("conv_id") % group}))
    givers = sizes.select(F.col("conv_id").alias("giver"), F.col("n").alias("giver_n"), F.col("first").alias("giver_first"))
    taken = F.least("h", F.coalesce("giver_n", F.lit(0).cast("long")))
    convs = sizes.join(givers, "giver", "left").withColumn("taken", taken)
    convs = cut_lineage(convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = numbered.join(convs.select("conv_id", "first", "h", "taken"), "conv_id")
    own = own.withColumn("at", F.col("no") - F.col("first")).filter("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    # a turn given away is found by its number; each is asked for at most once per conversation of a group
    asked = convs.filter("taken > 0").select(
        "conv_id", "giver_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("pos")
    )
    asked = asked.select("conv_id", "pos", (F.col("giver_first") + F.col("pos")).alias("no"))
    given = asked.join(numbered.select("no", "digest", "bytes"), "no").select("conv_id", "pos", "digest", "bytes")
    return own.unionByName(given), convs.select("conv_id", "n_turns")


def chained(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """``rows`` (conv_id, pos, digest, bytes) as (conv_id, pos, node, parent, bytes, through).

    ``node`` is the digest of the turns up to pos, ``parent`` that of those before it (null for the first),
    ``through`` the bytes up to pos.
    """
    at = F.pmod("pos", F.lit(piece))
    part = F.call_function("div", F.col("pos"), F.lit(piece).cast("long"))
    cut = rows.groupBy("conv_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), "digest", "bytes"))).alias("turns")
    )
    start = F.struct(
        F.lit(None).cast("binary").alias("node"),
        F.lit(0).cast("long").alias("sum"),
        F.array().cast("array<struct<node: binary, parent: binary, bytes: bigint, through: bigint>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        node = F.coalesce(sha(F.concat(acc["node"], x["digest"])), x["digest"])
        total = acc["sum"] + x["bytes"]
        one = F.struct(node.alias("node"), acc["node"].alias("parent"), x["bytes"].alias("bytes"), total.alias("through"))
        return F.struct(node.alias("node"), total.alias("sum"), F.concat(acc["out"], F.array(one)).alias("out"))

    pieces = cut_lineage(cut.select("conv_id", "part", F.aggregate("turns", start, step)["out"].alias("chain")))

    def after(own: Column) -> Column:
        return F.when(F.col("before").isNull(), own).otherwise(sha(F.concat("before", own)))

    nothing = F.lit(None).cast("binary")
    if pieces.filter("part > 0").isEmpty():
        placed = pieces.withColumns({"before": nothing, "last": nothing, "sum": F.lit(0).cast("long")})
    else:
        end = F.element_at("chain", -1)
        ends = pieces.select("conv_id", "part", end["node"].alias("digest"), end["through"].alias("bytes"))
        above = chained(ends.withColumnRenamed("part", "pos"), piece).select(
            "conv_id", (F.col("pos") + 1).alias("part"), F.col("node").alias("before"), F.col("through").alias("sum")
        )
        above = cut_lineage(above)
        # the last node of the piece before, the parent of this one's first
        last = ends.join(above.select("conv_id", "part", "before"), ["conv_id", "part"], "left")
        last = last.select("conv_id", (F.col("part") + 1).alias("part"), after(F.col("digest")).alias("last"))
        placed = pieces.join(above.join(last, ["conv_id", "part"]), ["conv_id", "part"], "left")
    out = placed.select("conv_id", "part", "before", "last", "sum", F.posexplode("chain").alias("at", "x"))
    return out.select(
        "conv_id",
        (F.col("part") * piece + F.col("at")).alias("pos"),
        after(F.col("x.node")).alias("node"),
        F.when(F.col("at") == 0, F.col("last")).otherwise(after(F.col("x.parent"))).alias("parent"),
        F.col("x.bytes").alias("bytes"),
        (F.coalesce("sum", F.lit(0)) + F.col("x.through")).alias("through"),
    )


def ends_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ids) in order of node and place to one digest per node; only one digest is open at a time."""
    node, state = None, None
    for batch in batches:
        done_nodes, done = [], []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done_nodes.append(node)
                done.append(state.hexdigest())
            node, state = n, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(done_nodes, pa.binary()), pa.array(done, pa.string())], names=["node", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])


def end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends): the hash of the ids of ``ends`` (node, conv_id), in order and joined by commas.

    Runs of neighbouring ids become one text each before they meet, so the hash of a node that ends a third of all
    conversations reads few rows, one after the other, and holds none of them.
    """
    run = F.call_function("div", F.col("conv_id"), F.lit(RUN).cast("long"))
    sign = F.when(F.col("conv_id") < 0, 0).otherwise(1)  # division cuts toward zero: keep -1 and 1 apart
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    runs = ends.groupBy("node", sign.alias("sign"), run.alias("run")).agg(ids.alias("ids"))
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(tasks, "node").sortWithinPartitions("node", "sign", "run")
    return map_arrow(dealt.select("node", "ids"), ends_worker, "node binary, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of the conversations ``convs`` with the turns ``turns``, see ``rebuilt``.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. A table without conversations has no nodes, not even a root.
    """
    chain = cut_lineage(chained(turns))
    ends = convs.withColumn("pos", F.col("n_turns") - 1).join(
        chain.select("conv_id", "pos", "node", F.col("through").alias("total")), ["conv_id", "pos"], "left"
    )
    ends = ends.withColumns({"node": F.coalesce("node", root()), "total": F.coalesce("total", F.lit(0).cast("long"))})
    ends = cut_lineage(ends.select("conv_id", "n_turns", "node", "total"))
    sequences = ends.groupBy("node", "n_turns").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("total").alias("total")
    )
    sequences = cut_lineage(sequences)

    # the prefixes of one conversation of each kind, its root included
    kept = sequences.select("conv_id", "weight", "total")
    steps = chain.join(kept, "conv_id").select(
        "conv_id", "weight", "total", (F.col("pos") + 1).alias("depth"), "node", F.coalesce("parent", root()).alias("parent"), "bytes", "through"
    )
    zero = F.lit(0).cast("long")
    tops = kept.select(
        "*", zero.alias("depth"), root().alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("bytes"), zero.alias("through")
    )
    prefixes = cut_lineage(steps.unionByName(tops))
    nodes = prefixes.groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        *(F.first(c).alias(c) for c in ("parent", "bytes", "through")),
    )
    nodes = cut_lineage(nodes)

    proper = prefixes.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = sequences.join(cut_lineage(proper), "node", "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    # where the nodes begin that have this sequence's conversation as smallest member, and the bytes before there
    own = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", (F.col("through") - F.col("bytes")).alias("before"))).alias("own"))
    known = cut_lineage(kept.select("conv_id").join(own, "conv_id", "left").join(leaves, "conv_id", "left"))
    told = prefixes.join(known, "conv_id").withColumn("before", F.col("through") - F.col("bytes"))
    rest = F.col("total") - F.greatest("before", F.col("own.before"))
    below = told.groupBy("node", "depth").agg(
        (F.sum(F.col("weight") * (F.col("total") - F.col("before"))) - F.sum(F.when(F.col("own").isNotNull(), rest).otherwise(0))).alias("saved_tokens"),
        F.sum(F.coalesce("leaf", zero)).alias("n_leaves"),
    )
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "parent", "left").join(below, ["node", "depth"])
    out = out.join(children.withColumnRenamed("parent", "node"), "node", "left").join(end_lists(ends.select("node", "conv_id")), "node", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``df`` (conv_id, turn, role, text); no other column is read.

    Null roles and texts are empty, turns with a null number come first, those with equal numbers in the order of their
    digests. Rows repeated in full are turns told twice. Rows without conv_id belong to no conversation.
    """
    turns, convs = rebuilt(df.select(*(col(c) for c in ("conv_id", "turn", "role", "text"))))
    return prefix_trie(turns, convs)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
