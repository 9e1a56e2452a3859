"""The trie of conversations' shared beginnings, measured by an Euler tour.

A node is a distinct sequence of first turns; it is named by its smallest member conversation and its
depth, so a conversation owns one unbroken chain of nodes, from where no smaller conversation
shares its turns down to its end. The tour enters every node, walks its children in order of
their names and leaves it again:

1. The tour's 2 arcs per node are linked by joins. Stretches that follow from the names alone (down
   a chain, up a chain without branches) are one list element, cut every ``STRETCH`` nodes so that a
   very long conversation is many.
2. The list is ranked by contraction: in each round every element whose drawn number beats both
   neighbours' leaves the list (a third of them), its length going to its predecessor. At most
   ``LAST`` elements, a constant, are walked in one task; then the rounds are undone in turn.
   The work of all rounds is a few times the first one's.
3. Arcs have dense positions now: prefix sums of leaves and of savings run in even blocks of
   positions, with the blocks' totals carried. A subtree's figure is the sum at its node's leaving
   arc less that at its entering arc.

No window or group holds a whole conversation, all children of a node or all members of a node:
sorted rows are numbered by range partitions, sums go by blocks, and the members that end at a
node are hashed as a stream of joined runs of ids. Rounds are stored in the shared folder.

Defined cases: rows without conv_id are left out; turns are in order of ``turn``, null first, equal
ones by the MD5 of role and text, repeated rows count each; null role or text is empty; a conversation that
is rebuilt without turns is a member of the root alone; an empty table gives no rows; other columns are ignored,
whatever they are called. Texts are hashed and counted where they lie and are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.session import stored

WORDS = r"[^\x20\x09-\x0D]+"
#: Nodes of one stretch, list elements walked in one task, turns or arcs of a block of sums, ids of one joined run.
STRETCH, LAST, BLOCK, RUN = 1024, 2000, 65536, 4096


# --- sorted rows ----------------------------------------------------------------------------------------


def _sorted(df: DataFrame, order: list[Column], purpose: str) -> DataFrame:
    """The rows, stored in ranges of ``order``, with the range _part and the place _row in it.

    Equal rows are told apart by where they were read, so they can fall into different ranges.
    """
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    return stored(ranged.select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), purpose)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, key, words): every turn with its position from 1 in its conversation, a digest of role and text,
    and the words of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    rows = _sorted(rows, [F.col("c"), F.col("turn").asc_nulls_first(), F.col("key")], "turns")
    ranges = rows.groupBy("c", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("c").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One conversation at most goes on from the range before: no more rows than ranges.
    carried = ranges.withColumn("_before", F.sum("_n").over(earlier)).where(F.col("_before").isNotNull()).drop("_n")
    local = F.row_number().over(W.partitionBy("_part", "c").orderBy("_row"))
    numbered = (
        rows.withColumn("_local", local.cast("long"))
        .join(F.broadcast(carried), ["c", "_part"], "left")
        .select("c", (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("pos"), "key", "words")
    )
    return stored(numbered, "numbered")


def shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that neighbours share their beginnings: conversation c takes the first
    h turns of conversation c - c % every, h = crc32(c) % most, then its own turns after its first h.

    Returns (c, total) for every conversation and (c, k, key, words) for every rebuilt turn.
    """
    h = F.crc32(F.col("c").cast("string")) % most
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % every)
    bases = sizes.select(F.col("c").alias("base"), F.col("n").alias("in_base"))
    taken = F.least("h", F.coalesce("in_base", F.lit(0)))
    members = stored(
        sizes.join(bases, "base", "left")
        .withColumn("taken", taken)
        .select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")),
        "members",
    )
    own = turns.where(F.col("pos") > h).join(members.select("c", "h", "taken"), "c").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("k"), "key", "words")
    heads = turns.where((F.col("pos") < most) & (F.col("c") % every == 0)).withColumnRenamed("c", "base")
    first = members.select("c", "base", "taken").join(heads, "base").where(F.col("pos") <= F.col("taken")).select("c", F.col("pos").alias("k"), "key", "words")
    return members.select("c", "total"), own.unionByName(first)


# --- nodes ------------------------------------------------------------------------------------------------


def _prefixes(turns: DataFrame) -> DataFrame:
    """Adds (p1, p2), 128 bits of a conversation's first k turns, and (q1, q2) of those before.

    The bits of turns at their positions are combined by exclusive or, in blocks of positions.
    """
    bits = [F.xxhash64(F.lit(i), "k", "key") for i in (1, 2)]
    rows = turns.withColumns({"_e1": bits[0], "_e2": bits[1], "_block": F.floor((F.col("k") - 1) / BLOCK)})
    here = W.partitionBy("c", "_block").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("c").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # Only conversations longer than a block have anything to carry.
    long = rows.where(F.col("_block") > 0).select("c").distinct()
    sums = rows.join(long, "c", "left_semi").groupBy("c", "_block").agg(F.bit_xor("_e1").alias("_s1"), F.bit_xor("_e2").alias("_s2"))
    carried = sums.select("c", "_block", F.bit_xor("_s1").over(before).alias("_b1"), F.bit_xor("_s2").over(before).alias("_b2"))
    out = rows.withColumns({"_r1": F.bit_xor("_e1").over(here), "_r2": F.bit_xor("_e2").over(here)}).join(carried, ["c", "_block"], "left")
    for i in ("1", "2"):
        out = out.withColumn("p" + i, F.col("_r" + i).bitwiseXOR(F.coalesce("_b" + i, F.lit(0).cast("long"))))
        out = out.withColumn("q" + i, F.col("p" + i).bitwiseXOR(F.col("_e" + i)))
    return out.select("c", "k", "words", "p1", "p2", "q1", "q2")


def _nodes(members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(c, d, n, words, p1, p2, q1, q2): the distinct prefixes and the root."""
    inner = prefixes.groupBy("p1", "p2", F.col("k").alias("d")).agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2")
    )
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = members.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 0")
    root = root.select("c", "n", zero.alias("d"), zero.alias("words"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"))
    return stored(inner.unionByName(root), "nodes")


def _chains(nodes: DataFrame) -> DataFrame:
    """(c, a, b, parent, sibling): each conversation's own nodes have depths a to b; the node at a hangs on
    (parent, a - 1), whose next child is (sibling, a)."""
    own = nodes.groupBy("c").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.min_by(F.struct("q1", "q2"), "d").alias("q"))
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("d") + 1).alias("a"), F.col("c").alias("parent"))
    linked = own.select("c", "a", "b", "q.q1", "q.q2").join(above, ["q1", "q2", "a"]).select("c", "a", "b", "parent")
    rows = _sorted(linked, [F.col("parent"), F.col("a"), F.col("c")], "siblings")
    place = F.struct("parent", "a", "c")
    firsts = rows.groupBy("_part").agg(F.min_by(place, "_row").alias("_first"))
    # One row per range.
    after = firsts.select("_part", F.lead("_first").over(W.partitionBy().orderBy("_part")).alias("_after"))
    following = F.coalesce(F.lead(place).over(W.partitionBy("_part").orderBy("_row")), F.col("_after"))
    same = (F.col("_next.parent") == F.col("parent")) & (F.col("_next.a") == F.col("a"))
    inner = rows.join(F.broadcast(after), "_part").withColumn("_next", following).select("c", "a", "b", "parent", F.when(same, F.col("_next.c")).alias("sibling"))
    none = F.lit(None).cast("long")
    root = own.where("a = 0").select("c", "a", "b", none.alias("parent"), none.alias("sibling"))
    return stored(inner.unionByName(root), "chains")


def _tour_nodes(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Nodes with all the tour needs to know of them; the list elements are (c, z)."""
    branches = chains.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("c"), (F.col("a") - 1).alias("d")).agg(
        F.count(F.lit(1)).alias("others"), F.min("c").alias("branch")
    )
    above = branches.select("c", (F.col("d") + 1).alias("d"), F.col("branch").alias("next_child"))
    rows = (
        nodes.select("c", "d", "n", "words")
        .join(chains, "c")
        .join(branches, ["c", "d"], "left")
        .join(above, ["c", "d"], "left")
        .withColumn("children", F.coalesce("others", F.lit(0)) + F.when(F.col("d") < F.col("b"), 1).otherwise(0))
        .withColumn("stretch", F.floor(F.col("d") / STRETCH))
        .withColumn("top", F.greatest(F.col("a"), F.col("stretch") * STRETCH))
        .withColumn("bottom", F.least(F.col("b"), F.col("stretch") * STRETCH + STRETCH - 1))
    )
    starts = (F.col("children") != 1) | (F.col("d") == F.col("bottom"))
    up = W.partitionBy("c", "stretch").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
    # The way up begins anew where it comes back from another child.
    return stored(rows.withColumn("head", F.min(F.when(starts, F.col("d"))).over(up)), "tour")


def _elements(tour: DataFrame) -> DataFrame:
    """(c, z, nc, nz, len): the linked list; z is even for the way down, odd for the way up."""

    def down(depth: Column) -> Column:
        return 2 * F.floor(depth / STRETCH)

    d, c = F.col("d"), F.col("c")
    goes_down = tour.where(d == F.col("bottom")).select(
        "c",
        down(d).alias("z"),
        F.when(F.col("children") == 0, c).when(d < F.col("b"), c).otherwise(F.col("branch")).alias("nc"),
        F.when(F.col("children") == 0, 2 * d + 1).otherwise(down(d + 1)).alias("nz"),
        (d - F.col("top") + 1).alias("len"),
    )
    child = F.when(d == F.col("a"), F.col("sibling")).otherwise(F.col("next_child"))
    above = F.when(d == F.col("a"), F.col("parent")).otherwise(c)
    goes_up = tour.where((d == F.col("top")) | F.col("next_child").isNotNull()).select(
        "c",
        (2 * F.col("head") + 1).alias("z"),
        F.coalesce(child, above).alias("nc"),
        F.when(child.isNotNull(), down(d)).when(above.isNotNull(), 2 * d - 1).alias("nz"),
        (F.col("head") - d + 1).alias("len"),
    )
    return goes_down.unionByName(goes_up)


# --- list ranking ------------------------------------------------------------------------------------------


def _walked(rows: pa.Table) -> pa.Table:
    """Positions of a short whole list."""
    own = {name: rows.column(name).to_pylist() for name in ("c", "z", "nc", "nz", "len", "pc")}
    following = {(c, z): (nc, nz, n) for c, z, nc, nz, n in zip(*[own[x] for x in ("c", "z", "nc", "nz", "len")])}
    here = next((c, z) for c, z, p in zip(own["c"], own["z"], own["pc"]) if p is None)
    out, at = [], 0
    while here in following:
        nc, nz, n = following[here]
        out.append((*here, at))
        here, at = (nc, nz), at + n
    return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("c", "z", "pos"), zip(*out))})


def ranked(elements: DataFrame, last: int = LAST) -> DataFrame:
    """(c, z, pos) of a linked list (c, z, nc, nz, len): how many places lie before each element."""
    none = F.lit(None).cast("long")
    named = elements.select("c", "z", "nc", "nz", "len", none.alias("pc"), none.alias("pz"))
    told = elements.where(F.col("nc").isNotNull()).select(
        F.col("nc").alias("c"), F.col("nz").alias("z"), none.alias("nc"), none.alias("nz"), none.alias("len"), F.col("c").alias("pc"), F.col("z").alias("pz")
    )
    rest = stored(named.unionByName(told).groupBy("c", "z").agg(*[F.max(x).alias(x) for x in ("nc", "nz", "len", "pc", "pz")]), "list")
    rounds = []
    while rest.count() > last:
        drawn = [F.xxhash64(F.lit(len(rounds)), F.col(x), F.col(y)) for x, y in (("c", "z"), ("pc", "pz"), ("nc", "nz"))]
        leaves = F.col("pc").isNotNull() & (drawn[0] > drawn[1]) & (F.col("nc").isNull() | (drawn[0] > drawn[2]))
        marked = rest.withColumn("gone", leaves)
        rounds.append(marked)
        stays, goes = marked.where(~F.col("gone")), marked.where(F.col("gone"))
        no = F.lit(False)
        empty = {x: none for x in ("nc", "nz", "len", "pc", "pz")}

        def notes(rows: DataFrame, c: str, z: str, next_is: Column, previous_is: Column, **known: Column) -> DataFrame:
            given = {**empty, **known}
            return rows.select(F.col(c).alias("c"), F.col(z).alias("z"), next_is.alias("_n"), previous_is.alias("_p"), *[v.alias(x) for x, v in given.items()])

        own = {x: F.col(x) for x in empty}
        yes = F.lit(True)
        mail = (
            notes(stays, "c", "z", no, no, **own)
            .unionByName(notes(goes, "pc", "pz", yes, no, nc=own["nc"], nz=own["nz"], len=own["len"]))
            .unionByName(notes(goes.where(F.col("nc").isNotNull()), "nc", "nz", no, yes, pc=own["pc"], pz=own["pz"]))
        )

        def newest(value: str, flag: str) -> Column:
            told_now = F.max(F.when(F.col(flag), F.col(value)))
            return F.when(F.max(flag), told_now).otherwise(F.max(F.when(~F.col(flag), F.col(value)))).alias(value)

        rest = stored(
            mail.groupBy("c", "z").agg(newest("nc", "_n"), newest("nz", "_n"), F.sum("len").alias("len"), newest("pc", "_p"), newest("pz", "_p")), "list"
        )
    out = rest.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_walked, "c long, z long, pos long")
    for marked in reversed(rounds):
        kept = marked.where(~F.col("gone")).join(out, ["c", "z"]).select("c", "z", "pos", "len")
        ahead = kept.select(F.col("c").alias("pc"), F.col("z").alias("pz"), (F.col("pos") + F.col("len")).alias("pos"))
        back = marked.where(F.col("gone")).select("c", "z", "pc", "pz").join(ahead, ["pc", "pz"]).select("c", "z", "pos")
        out = stored(kept.drop("len").unionByName(back), "ranked")
    return out


# --- sums over subtrees, members that end at a node -------------------------------------------------------------


def _subtree_sums(tour: DataFrame, places: DataFrame) -> DataFrame:
    """(c, d, n_leaves, saved_tokens) by prefix sums at the arcs' positions."""
    enter = places.select("c", F.col("z").alias("_down"), F.col("pos").alias("_enter"))
    leave = places.select("c", F.col("z").alias("_up"), F.col("pos").alias("_leave"))
    placed = (
        tour.withColumn("_down", 2 * F.col("stretch"))
        .withColumn("_up", 2 * F.col("head") + 1)
        .join(enter, ["c", "_down"])
        .join(leave, ["c", "_up"])
        .select(
            "c", "d",
            (F.col("_enter") + F.col("d") - F.col("top")).alias("enter"),
            (F.col("_leave") + F.col("head") - F.col("d")).alias("leave"),
            F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
            F.when(F.col("d") > 0, (F.col("n") - 1) * F.col("words")).otherwise(0).cast("long").alias("saved"),
        )
    )
    zero = F.lit(0).cast("long")
    arcs = placed.select("c", "d", F.explode(F.array(
        F.struct(F.col("enter").alias("pos"), F.lit(-1).alias("side"), "leaf", "saved"),
        F.struct(F.col("leave").alias("pos"), F.lit(1).alias("side"), zero.alias("leaf"), zero.alias("saved")),
    )).alias("arc")).select("c", "d", "arc.*").withColumn("block", F.floor(F.col("pos") / BLOCK))
    arcs = stored(arcs, "arcs")
    totals = arcs.groupBy("block").agg(F.sum("leaf").alias("_leaf"), F.sum("saved").alias("_saved"))
    earlier = W.partitionBy().orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row per 65,536 arcs
    carried = totals.select("block", *[F.coalesce(F.sum(x).over(earlier), zero).alias(x) for x in ("_leaf", "_saved")])
    here = W.partitionBy("block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    summed = arcs.withColumns({"leaves": F.sum("leaf").over(here), "savings": F.sum("saved").over(here)}).join(carried, "block")

    def below(own: str, here: str, before: str) -> Column:
        up_to = F.col(before) + F.col(here)
        return F.sum(F.when(F.col("side") > 0, up_to).otherwise(F.col(own) - up_to))

    return summed.groupBy("c", "d").agg(below("leaf", "leaves", "_leaf").alias("n_leaves"), below("saved", "savings", "_saved").alias("saved_tokens"))


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (c, d, id) to runs (c, d, first, ids): up to RUN ids of one node, joined by commas."""
    for batch in batches:
        c, d, ids = (batch.column(i).to_numpy() for i in range(3))
        if not len(c):
            continue
        cut = np.flatnonzero((c[1:] != c[:-1]) | (d[1:] != d[:-1])) + 1
        edges = np.unique(np.concatenate([[0], cut, np.arange(0, len(c), RUN), [len(c)]]))
        heads = edges[:-1]
        runs = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(heads, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c[heads]), pa.array(d[heads]), pa.array(ids[heads]), pa.array(runs, pa.string())], names=["c", "d", "first", "ids"])


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order to (c, d, sha) of each node's ids, as a stream."""
    node, digest, done = None, None, []
    for batch in batches:
        for c, d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (c, d) != node:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (c, d), hashlib.sha256(ids.encode())
            else:
                digest.update(b",")
                digest.update(ids.encode())
        if len(done) >= RUN:
            yield _digests(done)
            done = []
    if node:
        done.append((*node, digest.hexdigest()))
    if done:
        yield _digests(done)


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    c, d, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(sha, pa.string())], names=["c", "d", "sha"])


def _end_digests(members: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, d, sha) of every node at which members end."""
    ends = members.where("total > 0").select("c", F.col("total").alias("k")).join(prefixes.select("c", "k", "p1", "p2"), ["c", "k"])
    keys = nodes.select("p1", "p2", F.col("d").alias("k"), F.col("c").alias("_node"))
    inner = ends.join(keys, ["p1", "p2", "k"]).select(F.col("_node").alias("c"), F.col("k").alias("d"), F.col("c").alias("id"))
    root = nodes.where("d = 0").select("c", "d")
    idle = members.where("total = 0").select(F.col("c").alias("id"), F.lit(0).cast("long").alias("d")).join(F.broadcast(root), "d").select("c", "d", "id")
    rows = inner.unionByName(idle)
    runs = rows.repartitionByRange("c", "d", "id").sortWithinPartitions("c", "d", "id").mapInArrow(_joined_runs, "c long, d long, first long, ids string")
    return runs.repartition("c", "d").sortWithinPartitions("c", "d", "first").mapInArrow(_hashed_runs, "c long, d long, sha string")


def prefix_trie(members: DataFrame, turns: DataFrame, last: int = LAST) -> DataFrame:
    """One row per node of the trie of conversations ``members`` (c, total) with ``turns`` (c, k, key, words).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (of the node's whole
    subtree), ends_sha256 (SHA-256 of the sorted ids of the members that end here).
    """
    prefixes = stored(_prefixes(turns), "prefixes")
    nodes = _nodes(members, prefixes)
    tour = _tour_nodes(nodes, _chains(nodes))
    sums = _subtree_sums(tour, ranked(_elements(tour), last))
    parent = F.when(F.col("d") > F.col("a"), F.col("c")).otherwise(F.col("parent"))
    return (
        tour.select("c", "d", parent.alias("parent_conv_id"), "n", "children")
        .join(sums, ["c", "d"])
        .join(_end_digests(members, prefixes, nodes), ["c", "d"], "left")
        .select(
            F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
            F.col("children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
