"""The trie of conversation prefixes by van Emde Boas recursion.

Sequences of turns are cut at half the depth of their trie.  Cut prefixes are named, equal ones alike; they are the leaves of the
upper trie, and each name is the root of a forest of what follows it.  Both halves are cut again, all pieces of one size together:
after as many rounds as the depth has binary digits every piece is one turn, and every prefix has its name.  A round joins the names
of its pieces' roots with digests of half a piece, which a first series of rounds has made from those of halves of it.

Then totals are grafted upward, from the smallest pieces to the largest: what the lower forests hold under a cut prefix is added to the
nodes above it in the upper trie.  Within a round no piece waits for another.

Conversations are rows of single turns all the time; no conversation, prefix or name is ever gathered in one row or task, and all
sums are partial aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltrace.llm.digests import joined_digests
from siltrace.llm.storage import dropped, written
from siltrace.operators.joins import looked_up
from siltrace.operators.ranks import cumulated


def _root() -> Column:
    """The name of the empty prefix."""
    return F.lit(bytes(16))


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def conversation_turns(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, pos, key, bytes): turns numbered from 0 in each conversation, by turn (null first), then by digest of role and text.

    key: 128 bits of SHA-256 of role and text, of which null ones are empty; bytes: of the text in UTF-8.  Rows without a conversation take no
    part.  Numbers are counted over ranges of the order, so that a very long conversation lies in many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = _digest(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")
    ).filter("conv IS NOT NULL")
    counted = cumulated(rows, [F.asc_nulls_first("turn"), F.col("key")], {"pos": F.lit(1)}, by=["conv"])
    return counted.select("conv", F.col("pos").cast("long").alias("pos"), "key", "bytes")


def with_lengths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with the length of their conversation, lengths by conversation)."""
    lengths = written(turns.groupBy("conv").agg(F.count("*").alias("len")), "lengths")
    return looked_up(turns, lengths, ["conv"]), lengths


def _blocks(turns: DataFrame, rounds: int) -> list[DataFrame]:
    """Digests of the turns [b * 2**k, (b + 1) * 2**k) of each conversation, for each k below ``rounds``; bytes: of the last turn's text."""
    out = [turns.select("conv", F.col("pos").alias("b"), "key", "bytes", "len")]
    for _ in range(1, rounds):
        odd = F.col("b") % 2 == 1
        halves = out[-1].groupBy("conv", F.shiftright("b", 1).alias("b")).agg(
            F.max(F.when(~odd, F.col("key"))).alias("left"), F.max(F.when(odd, F.col("key"))).alias("right"), F.max(F.when(odd, F.col("bytes"))).alias("bytes"), F.max("len").alias("len")
        )
        out.append(written(halves.filter("right IS NOT NULL").select("conv", "b", _digest("left", "right").alias("key"), "bytes", "len"), "turn-blocks"))
    return out


def _named(blocks: list[DataFrame]) -> list[DataFrame]:
    """For each round, from the smallest pieces to the largest: (conv, depth, name, bytes, len) of the prefixes cut in it."""
    named: list[DataFrame] = []
    for half in reversed(range(len(blocks))):
        # Pieces of 2 * 2**half turns, cut after 2**half of them.
        first = blocks[half].filter(F.col("b") % 2 == 0).withColumn("lo", F.shiftleft("b", half))
        name = lambda root: _digest(root, F.col("key")).alias("name")
        columns = lambda root: ["conv", (F.col("lo") + (1 << half)).alias("depth"), name(root), "bytes", "len"]
        own = first.filter("lo = 0").select(*columns(_root()))
        if named:
            roots = _union(named).select("conv", F.col("depth").alias("lo"), F.col("name").alias("root"))
            own = own.unionByName(first.filter("lo > 0").hint("merge").join(roots, ["conv", "lo"]).select(*columns(F.col("root"))))
        named.append(written(own, "cut-prefixes"))
        if half:
            dropped(blocks[half])
    return named[::-1]


def _grafted(nodes: list[DataFrame], named: list[DataFrame]) -> list[DataFrame]:
    """(name, depth, leaves, saved, children) to be added to nodes above, by the round in which they were found."""
    grafts: list[DataFrame] = []
    for half, own in enumerate(nodes):
        size = 1 << half
        total = own.select("name", "conv", "depth", "leaves", "saved")
        if grafts:
            below = _union(grafts).filter(F.col("depth").bitwiseAND(2 * size - 1) == size)
            below = below.groupBy("name").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            total = total.hint("merge").join(below, "name", "left").select(
                "name", "conv", "depth", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
            )
        # The nodes of the upper trie above a cut prefix are the shorter prefixes of its smallest member.
        at = F.explode(F.sequence(F.col("depth") - size, F.col("depth") - 1)).alias("above")
        up = total.select("conv", at, "leaves", "saved", "depth").withColumn("children", (F.col("above") == F.col("depth") - 1).cast("long"))
        paths = _union(named).filter(F.col("len") >= size).select("conv", F.col("depth").alias("above"), "name")
        met = up.hint("merge").join(paths, ["conv", "above"], "left").withColumn("name", F.coalesce("name", _root()))
        sums = [F.sum(c).alias(c) for c in ("leaves", "saved", "children")]
        grafts.append(written(met.groupBy("name", F.col("above").alias("depth")).agg(*sums), "grafts"))
    return grafts


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences of turns, the empty one included.

    turns: (conv, pos, key, bytes, len) of each turn, pos from 0 to len - 1; prefixes are equal if their keys are.
    conversations: (conv, len), those without turns too.  Both are read several times: give written tables.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs (members, that is
    conversations that begin with the prefix), n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree,
    members but one times bytes of the last turn), ends_sha256 (of the decimal ids, ascending and joined by commas, of the members that end
    there).  (conv_id, depth) is unique.  Without conversations there is no row.
    """
    longest = conversations.agg(F.max("len").alias("n")).first()["n"]
    rounds = int(longest or 0).bit_length()
    named = _named(_blocks(turns, rounds)) if rounds else []
    nodes = []
    for own in named:
        # A prefix is a leaf if all its members end there.
        found = own.groupBy("name").agg(
            F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("len").alias("longest")
        )
        leaf = (F.col("longest") == F.col("depth")).cast("long")
        nodes.append(written(found.select("name", "conv", "depth", "n_convs", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "nodes"))
    grafts = _grafted(nodes, named)

    root = conversations.groupBy().agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.coalesce(F.max("len") == 0, F.lit(False)).cast("long").alias("leaves"))
    root = root.filter("n_convs > 0").select(_root().alias("name"), "conv", F.lit(0).cast("long").alias("depth"), "n_convs", "leaves", F.lit(0).cast("long").alias("saved"))
    every = _union([root, *nodes])
    ends = [conversations.filter("len = 0").select(_root().alias("name"), "conv"), *[own.filter("depth = len").select("name", "conv") for own in named]]
    # At most 4,096 ids in a row before they are hashed in order.
    ids = _union(ends).groupBy("name", F.shiftright("conv", 12).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    digests = joined_digests(ids, "name", ["range"], "ids").select(F.col("key").alias("name"), F.col("digest").alias("ends"))
    told = every.hint("merge").join(digests, "name", "left")
    if grafts:
        sums = _union(grafts).groupBy("name").agg(*[F.sum(c).alias(f"more_{c}") for c in ("leaves", "saved", "children")])
        told = told.hint("merge").join(sums, "name", "left")
        above = _union(named).select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
        told = told.hint("merge").join(above, ["conv", "depth"], "left").withColumn("parent", F.when(F.col("depth") > 0, F.coalesce("parent", _root())))
    else:
        told = told.select("*", *[F.lit(0).cast("long").alias(f"more_{c}") for c in ("leaves", "saved", "children")], F.lit(None).cast("binary").alias("parent"))
    told = written(told, "trie")
    parents = told.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    placed = looked_up(told, parents, ["parent"])
    return placed.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("more_children", F.lit(0)).alias("n_children"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """:func:`prefix_trie` of a table of conversations, one turn a row; columns: those of :func:`conversation_turns`.

    Null roles and texts are empty; turns of one number are ordered by a digest of role and text, and equal ones are several
    turns.  Rows without a conversation take no part.  Whole texts are used; an empty table gives an empty result; other
    columns are not read.
    """
    turns, lengths = with_lengths(written(conversation_turns(conversations, **columns), "turns"))
    return prefix_trie(written(turns, "turns-of-lengths"), lengths)
