"""Prefix trie of conversations, kept compacted and searched as a z-fast trie.

A conversation is a sequence of turns. Its prefixes are named by 128-bit hashes that are sums over the turns, each hashed with its
place, so that prefix hashes of a conversation of any length are a running sum cut into blocks. Texts are hashed where they are
read and never travel.

The compacted trie holds only the prefixes where conversations end or part. The node whose edge covers the depths ``(low, depth]``
is filed under the hash of its prefix of *two-fattest* length in that interval (the number divisible by the largest power of two).
A conversation finds the place where it leaves the trie by fat binary search: it probes the two-fattest depth of its open interval,
goes on below the node it finds or above the depth where it finds none, and is done after log2(length) joins. All waiting
conversations search together. Then one batch goes in: of those that leave at one place with the same next turn the longest, and
all that end inside an edge; edges are cut where they leave. The others search again in the grown trie. Every round passes at least
one branching, and as the longest goes in first, chains of prefixes need two rounds.

Measures of subtrees are summed over the compacted nodes by pointer doubling; at the end edges are expanded to one row per depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import written
from linewatch.llm.mixing import word_count

BLOCK = 65_536  # turns, or ids, that a task takes at once
_LOW = 0xFFFFFFFF
_ZERO = "named_struct('e', 0L, 'a', 0L, 'b', 0L)"


# -- turns -------------------------------------------------------------------------------------------------------------


def numbered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, pos, m1, m2, words)``: the turns of each conversation numbered from 1, their content as two hashes.

    Order is by turn, null first; turns of equal number are ordered by the hashes of role and text. The rows are laid out by
    ranges of (conversation, turn), so a long conversation spans many tasks: numbers count within a range, and the few ranges
    that begin inside a conversation add what lies before them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, F.lit("\n"), text).alias("m1"),
        F.xxhash64(F.lit(2), text, F.lit("\n"), role).alias("m2"),
        word_count(text_col).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("turn").asc_nulls_first(), "m1", "m2", "_row"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = turns.repartitionByRange(max(parts, 2), "conv", *order).withColumn("_range", F.spark_partition_id())
    laid = written(laid, "turns")
    sizes = laid.groupBy("conv", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range at most: only the first conversation of a range can have begun before it.
    offsets = sizes.withColumn("_before", F.sum("_n").over(before)).filter("_before is not null").drop("_n")
    within = Window.partitionBy("conv", "_range").orderBy(*order)
    placed = laid.withColumn("_at", F.row_number().over(within)).join(F.broadcast(offsets), ["conv", "_range"], "left")
    pos = F.col("_at") + F.coalesce("_before", F.lit(0))
    return placed.select("conv", pos.cast("long").alias("pos"), "m1", "m2", "words")


def rebuilt_turns(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(turns, conversations)`` where each conversation c begins with the first h turns of conversation c - c % family.

    h is crc32 of c in decimal modulo ``heads``; the conversation's own turns follow after its first h. The second table holds
    ``(conv, length)`` of all conversations, turnless ones too.
    """
    head = (F.crc32(F.col("conv").cast("string")) % heads).cast("long")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv") - F.col("conv") % family
    convs = (
        sizes.withColumns({"h": head, "base": base})
        .join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("_nb")), "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("_nb", F.lit(0))))
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    convs = written(convs.select("conv", "base", "h", "taken", "length"), "conversations")
    own = turns.withColumn("_h", head).filter("pos > _h").join(convs.select("conv", "taken"), "conv")
    own = own.select("conv", (F.col("pos") - F.col("_h") + F.col("taken")).alias("pos"), "m1", "m2", "words")
    lent = convs.filter("taken > 0").select("conv", "base", F.explode(F.expr("sequence(1L, taken)")).alias("pos"))
    firsts = turns.filter(F.col("pos") < heads).withColumnRenamed("conv", "base")
    lent = lent.join(firsts, ["base", "pos"]).select("conv", "pos", "m1", "m2", "words")
    return own.unionByName(lent), convs.select("conv", "length")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv, pos, a, b, words)``, written down: the hash of each prefix in two longs and the words up to its end."""
    one, two = F.xxhash64(F.lit(1), "pos", "m1", "m2"), F.xxhash64(F.lit(2), "pos", "m2", "m1")
    lanes = [one.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(one, 32), two.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(two, 32)]
    sums = ["_s0", "_s1", "_s2", "_s3", "words"]
    rows = turns.select(
        "conv", "pos", F.floor((F.col("pos") - 1) / block).alias("_block"), *[x.alias(f"_s{i}") for i, x in enumerate(lanes)], "words"
    )
    rows = written(rows, "lanes")
    within = Window.partitionBy("conv", "_block").orderBy("pos")
    summed = rows.select("conv", "pos", "_block", *[F.sum(c).over(within).alias(c) for c in sums])
    if not rows.filter("_block > 0").isEmpty():
        before = Window.partitionBy("conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.groupBy("conv", "_block").agg(*[F.sum(c).alias(c) for c in sums])
        offsets = totals.select("conv", "_block", *[F.sum(c).over(before).alias(f"{c}_before") for c in sums]).filter("_block > 0")
        summed = summed.join(offsets, ["conv", "_block"], "left").withColumns(
            {c: F.col(c) + F.coalesce(f"{c}_before", F.lit(0)) for c in sums}
        )

    def joined(high: str, low: str) -> Column:
        return F.shiftleft(F.col(high).bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(F.col(low).bitwiseAND(F.lit(_LOW)))

    return written(summed.select("conv", "pos", joined("_s0", "_s1").alias("a"), joined("_s2", "_s3").alias("b"), "words"), "prefixes")


# -- the trie ----------------------------------------------------------------------------------------------------------


def fattest(low: str, high: str) -> str:
    """SQL for the number in (low, high] that the largest power of two divides."""
    return f"({high} - {high} % shiftleft(1L, length(bin({low} ^ {high})) - 1))"


def _common(mine: str, other: str) -> str:
    """SQL for the number of leading entries that two arrays share."""
    differs = f"array_position(zip_with({mine}, {other}, (x, y) -> x <=> y), false)"
    return f"if({differs} = 0, size({mine}), {differs} - 1)"


def sequences(prefix: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``(ends, classes, waiting, most)``: where each conversation ends; distinct conversations with their members' number and
    smallest id; those that have turns, with the hashes of their prefixes; and the depth up to which hashes are kept.

    Beyond one turn more than the second longest nothing can be shared, so a conversation that holds most of the turns is no
    larger here than the next.
    """
    ends = convs.join(prefix.select("conv", F.col("pos").alias("length"), "a", "b"), ["conv", "length"], "left")
    zero = F.lit(0).cast("long")
    ends = ends.select("conv", F.struct(F.col("length").alias("e"), F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b")).alias("id"))
    ends = written(ends, "ends")
    classes = written(ends.groupBy("id").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    longest = [r["e"] for r in classes.select("id.e").orderBy(F.desc("e")).limit(2).collect()]
    most = 1 + (longest[1] if len(longest) > 1 else 0)
    chosen = classes.filter("id.e > 0").select(F.col("rep").alias("conv"), "id")
    hashes = (
        prefix.filter(F.col("pos") <= most)
        .join(chosen, "conv")
        .groupBy("conv", "id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("hs"))
    )
    waiting = hashes.select(F.col("conv").alias("rep"), "id", F.expr("transform(hs, x -> struct(x.a as a, x.b as b))").alias("hs"))
    return ends, classes, written(waiting, "waiting"), most


def _located(waiting: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Where the waiting conversations leave the trie: depth ``p`` and the ``edge`` they leave, null below a node.

    Conversations that end at a node have ``p`` = their length and no edge.
    """
    edge = F.struct("id", "low", "rep", "hs").alias("_edge")
    reach = f"least(id.e, {most}L)"
    handles = nodes.filter("id.e > 0").withColumn("_f", F.expr(fattest("low", reach)))
    handles = handles.select("_f", F.expr("hs[int(_f - 1)].a").alias("_a"), F.expr("hs[int(_f - 1)].b").alias("_b"), edge)
    handles = written(handles, "handles")
    q = waiting.withColumns({"lo": F.lit(0).cast("long"), "hi": F.expr(reach), "p": F.lit(None).cast("long")})
    q = q.withColumn("edge", F.lit(None).cast(handles.schema["_edge"].dataType))
    for _ in range(most.bit_length() + 1):
        open_ = F.expr("p is null and lo < hi")
        q = q.withColumn("_f", F.when(open_, F.expr(fattest("lo", "hi"))).otherwise(F.lit(-1).cast("long")))
        # Those that are done keep their own key, which matches nothing and is spread over all tasks.
        q = q.withColumn("_a", F.expr("if(_f > 0, hs[int(_f - 1)].a, id.a)")).withColumn("_b", F.expr("if(_f > 0, hs[int(_f - 1)].b, id.b)"))
        q = q.join(handles, ["_f", "_a", "_b"], "left")
        q = q.withColumn("_c", F.expr(f"case when _edge is not null then least(cast({_common('hs', '_edge.hs')} as long), _edge.id.e) end"))
        q = q.withColumns(
            {
                "p": F.expr("case when _c < _edge.id.e then _c else p end"),
                "edge": F.expr("case when _c < _edge.id.e then _edge else edge end"),
                "lo": F.expr("case when _c >= _edge.id.e then _edge.id.e else lo end"),
                "hi": F.expr("case when _f > 0 and _edge is null then _f - 1 else hi end"),
            }
        ).drop("_f", "_a", "_b", "_c", "_edge")
    # Below the deepest node met, the edge that begins with the same turn.
    edges = nodes.filter("id.e > 0").select(
        (F.col("low") + 1).alias("_f"), F.expr("hs[int(low)].a").alias("_a"), F.expr("hs[int(low)].b").alias("_b"), edge
    )
    below = F.expr("p is null and lo < id.e")
    q = q.withColumn("_f", F.when(below, F.col("lo") + 1).otherwise(F.lit(-1).cast("long")))
    q = q.withColumn("_a", F.expr("if(_f > 0, hs[int(_f - 1)].a, id.a)")).withColumn("_b", F.expr("if(_f > 0, hs[int(_f - 1)].b, id.b)"))
    q = q.join(edges, ["_f", "_a", "_b"], "left")
    met = F.expr(f"least(cast({_common('hs', '_edge.hs')} as long), _edge.id.e)")
    return q.select(
        "rep", "id", "hs",
        F.when(F.col("_edge").isNotNull(), met).otherwise(F.coalesce("p", "lo")).alias("p"),
        F.coalesce("_edge", "edge").alias("edge"),
    )


def grow(waiting: DataFrame, most: int) -> DataFrame:
    """The compacted trie ``(id, low, rep, hs)``: ``id`` is depth and hash of a node, ``low`` the depth of its parent, ``rep`` a
    conversation through it, ``hs`` the hashes of that one's prefixes."""
    spark = waiting.sparkSession
    root = spark.range(1).select(F.expr(_ZERO).alias("id"), F.lit(-1).cast("long").alias("low"), F.lit(None).cast("long").alias("rep"))
    nodes = root.withColumn("hs", F.lit(None).cast(waiting.schema["hs"].dataType))
    nodes, first = written(nodes, "nodes"), True
    while not waiting.isEmpty():
        if first:
            found = waiting.withColumns({"p": F.lit(0).cast("long"), "edge": F.lit(None).cast(nodes.select(F.struct("*")).schema[0].dataType)})
        else:
            found = _located(waiting, nodes, most)
        found, first = written(found, "located"), False
        ending = found.filter("p = id.e")
        parting = found.filter("p < id.e").withColumn("_next", F.expr("hs[int(p)]"))
        chosen = parting.groupBy("p", "_next").agg(
            F.max_by(F.struct("rep", "id", "hs", "edge"), F.col("id")).alias("_q")
        )  # the longest; of equally long ones that with the largest hash
        chosen = written(chosen.select("_q.*", "p"), "batch")
        cuts = chosen.select("edge", "p").unionByName(ending.select("edge", "p")).filter("edge is not null").distinct()
        touched = cuts.select("edge").distinct()
        cut_nodes = cuts.select(
            F.col("edge.id").alias("_owner"),
            F.struct(F.col("p").alias("e"), F.expr("edge.hs[int(p - 1)].a").alias("a"), F.expr("edge.hs[int(p - 1)].b").alias("b")).alias("id"),
            F.col("edge.low").alias("_top"), F.col("edge.rep").alias("rep"), F.col("edge.hs").alias("hs"),
        ).unionByName(
            touched.select(
                F.col("edge.id").alias("_owner"), F.col("edge.id").alias("id"), F.col("edge.low").alias("_top"),
                F.col("edge.rep").alias("rep"), F.col("edge.hs").alias("hs"),
            )
        )
        chain = Window.partitionBy("_owner").orderBy("id.e")
        chained = cut_nodes.select("id", F.coalesce(F.lag("id.e").over(chain), F.col("_top")).alias("low"), "rep", "hs")
        leaves = chosen.select("id", F.col("p").alias("low"), "rep", "hs")
        kept = nodes.join(touched.select(F.col("edge.id").alias("id")), "id", "left_anti").select("id", "low", "rep", "hs")
        nodes = written(kept.unionByName(chained).unionByName(leaves), "nodes")
        waiting = written(parting.join(chosen.select("rep"), "rep", "left_anti").select("rep", "id", "hs"), "waiting")
    return nodes


# -- measures ----------------------------------------------------------------------------------------------------------


def jumps_to_root(nodes: DataFrame) -> list[DataFrame]:
    """``(id, up)`` for the ancestors 1, 2, 4, ... steps above, as far as there are any."""
    up = F.expr(f"if(low = 0, {_ZERO}, struct(low as e, hs[int(low - 1)].a as a, hs[int(low - 1)].b as b))")
    step = written(nodes.filter("id.e > 0").select("id", up.alias("up")), "up")
    found = []
    while not step.isEmpty():
        found.append(step)
        further = step.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        step = written(step.join(further, "up").select("id", F.col("_up").alias("up")), "up")
    return found


def over_subtrees(values: DataFrame, jumps: list[DataFrame], sums: list[str], least: list[str] = ()) -> DataFrame:
    """Sums and minima of ``values`` (one row per ``id``) over each node's subtree, itself included, by pointer doubling."""
    for jump in jumps:
        parts = [F.sum(c).alias(f"_{c}") for c in sums] + [F.min(c).alias(f"_{c}") for c in least]
        added = values.join(jump, "id").groupBy(F.col("up").alias("id")).agg(*parts)
        both = values.join(added, "id", "left")
        values = both.select(
            "id",
            *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums],
            *[F.least(c, f"_{c}").alias(c) for c in least],
        )
        values = written(values, "subtrees")
    return values


def id_digests(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(id, ends_sha256)``: SHA-256 of the comma-joined ascending ids of the conversations that end at a node.

    Ids are joined to texts of ``block`` consecutive numbers at most; a digest is fed with one such text after the other, so a node
    where very many end needs no more memory than any other.
    """
    texts = (
        ends.groupBy("id", F.floor(F.col("conv") / block).alias("_block"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("_ids"))
        .select("id.*", "_block", "_ids")
        .repartition("e", "a", "b")
        .sortWithinPartitions("e", "a", "b", "_block")
    )

    def digest(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for e, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (e, a, b) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (e, a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield rows(done)
        if now:
            yield rows([(*now, state.hexdigest())])

    def rows(done):
        e, a, b, sha = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(e, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha)], ["e", "a", "b", "sha"]
        )

    found = texts.mapInArrow(digest, "e long, a long, b long, sha string")
    return found.select(F.struct("e", "a", "b").alias("id"), F.col("sha").alias("ends_sha256"))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv, pos`` (from 1, without gaps), ``m1, m2`` (hashes of the turn) and ``words``; ``convs`` has ``conv`` and
    ``length`` of every conversation. Without conversations the result is empty.
    """
    prefix = prefixes(turns, block)
    ends, classes, waiting, most = sequences(prefix, convs)
    nodes = grow(waiting, most)
    if classes.isEmpty():
        nodes = nodes.limit(0)
    jumps = jumps_to_root(nodes)
    children = jumps[0].groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children")) if jumps else None
    own = nodes.join(classes.select("id", "n", F.col("rep").alias("least")), "id", "left")
    own = own.join(children, "id", "left") if children else own.withColumn("n_children", F.lit(None).cast("long"))
    own = own.select(
        "id", "low", "rep", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_children", F.lit(0)).alias("n_children")
    )
    own = written(own.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "own")
    total = over_subtrees(own.select("id", "n", "n_leaves", "least"), jumps, ["n", "n_leaves"], ["least"])

    to_end = prefix.select(F.col("conv").alias("rep"), F.col("pos").alias("_e"), F.col("words").alias("_to_end"))
    to_low = prefix.select(F.col("conv").alias("rep"), F.col("pos").alias("low"), F.col("words").alias("_to_low"))
    edges = own.select("id", "low", "rep", "n_children", F.col("id.e").alias("_e")).join(total, "id")
    edges = edges.join(to_end, ["rep", "_e"], "left").join(to_low, ["rep", "low"], "left")
    edges = edges.withColumns({"_to_end": F.coalesce("_to_end", F.lit(0)), "_to_low": F.coalesce("_to_low", F.lit(0))})
    edges = edges.withColumn("saved", (F.col("n") - 1) * (F.col("_to_end") - F.col("_to_low")))
    edges = written(edges, "edges")
    below = over_subtrees(edges.select("id", "saved"), jumps, ["saved"]).withColumnRenamed("saved", "_subtree")
    edges = edges.join(below, "id").withColumn("_below", F.col("_subtree") - F.col("saved"))
    if jumps:
        above = jumps[0].join(total.select(F.col("id").alias("up"), F.col("least").alias("_parent")), "up").drop("up")
        edges = edges.join(above, "id", "left")
    else:
        edges = edges.withColumn("_parent", F.lit(None).cast("long"))
    edges = edges.join(id_digests(ends, block), "id", "left")

    # Edges expanded to depths, in blocks, so that no row holds all depths of a long one.
    spans = edges.withColumn("_first", F.explode(F.expr(f"sequence(low + 1, _e, {block}L)")))
    depths = spans.withColumn("depth", F.explode(F.expr(f"sequence(_first, least(_first + {block - 1}, _e))")))
    before = prefix.select(F.col("conv").alias("rep"), (F.col("pos") + 1).alias("depth"), F.col("words").alias("_before"))
    depths = depths.join(before, ["rep", "depth"], "left")
    end, empty = F.col("depth") == F.col("_e"), hashlib.sha256(b"").hexdigest()
    return depths.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("low") + 1, F.col("_parent")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        ((F.col("n") - 1) * (F.col("_to_end") - F.coalesce("_before", F.lit(0))) + F.col("_below")).cast("long").alias("saved_tokens"),
        F.when(end, F.coalesce("ends_sha256", F.lit(empty))).otherwise(empty).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    family: int | None = None,
    heads: int = 4,
) -> DataFrame:
    """The prefix trie of a table of turns, with ``family`` of the conversations rebuilt by ``rebuilt_turns``.

    Null roles and texts count as empty; a null turn comes first; equal turn numbers are ordered by a hash of role and text, and
    repeated rows are turns of their own. Rows without a conversation id belong to no conversation. Ids are whole numbers.
    Texts of any length are hashed and counted where they are read. Other columns are not read. An empty table gives no rows.
    """
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    if family is None:
        convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))
    else:
        turns, convs = rebuilt_turns(turns, family, heads)
    return prefix_trie(turns, convs)
