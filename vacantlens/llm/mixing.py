"""Mixing sources to target weights with Sainte-Laguë apportionment.

The mix has as many words as the corpus. Its equal blocks of ``BLOCK`` words are seats: sources
win them by the highest quotients of their targets, and inside a source its shards win the
source's seats the same way, so every shard has an integer quota. A source has shards by its own
rows, one if it is small. A shard is a seeded order of some of a source's documents, cut into
blocks; the last may be shorter, so the seats' words are turned into blocks of the shard's mean
length. A quota of m whole rounds and r more takes every
block m times and r of its n blocks once more, evenly spaced from a seeded start. How many of
those lie before a word is a closed form, so no row per block is ever made.

Defined cases: a null or wordless text has size 0 and takes 0; a null source is a source of its
own, last in order; rows that repeat a doc_id are separate documents; a null doc_id is ordered
as the empty string; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
#: Words per block, most copies of a document, documents per shard.
BLOCK, CEILING, SHARD_ROWS = 32, 3, 50_000


def _drawn(*parts: Column) -> Column:
    """60 seeded bits as a non-negative long; the same in any SQL engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) to the same with weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at ``ceiling``
    times its source's size; what is cut off goes to the others by weight until none is above.
    """
    everything = W.partitionBy()
    ordered = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weighed = ordered.withColumn("weight", (F.col("_rank") - 1) % 3 + 1).withColumn("_most", F.lit(ceiling) * F.col("source_size"))
    # In order of how soon a source is full, the level at which each would be filled if all
    # before it are full: the first that is not full at its level sets the level of the rest.
    rising = everything.orderBy(F.col("_most") / F.col("weight"), "_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    total, weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - (F.sum("_most").over(rising) - F.col("_most"))
    level = left.cast("double") / (weights - (F.sum("weight").over(rising) - F.col("weight"))).cast("double")
    levelled = weighed.withColumn("_level", level).withColumn("_full", F.col("_most") < F.col("weight") * F.col("_level"))
    first = F.min(F.when(~F.col("_full"), F.struct(F.col("_most") / F.col("weight"), F.col("_rank"), F.col("_level").alias("level")))).over(everything)
    target = F.when(F.col("_full"), F.col("_most").cast("double")).otherwise(F.col("weight") * first["level"])
    return levelled.withColumn("target", target).select("source", "source_size", "weight", "target")


def apportion(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: the ``seats`` of each group go to the highest quotients votes / (2k + 1).

    Seats that every party is sure of come from one division; only the few quotients around the
    last seat are ranked. Equal quotients: first in ``order``. Adds ``quota``.
    """
    own = W.partitionBy(*group)
    total, parts = F.sum(votes).over(own), F.count(F.lit(1)).over(own)
    low = F.col(seats) - parts / 2 - 1
    high = F.col(seats) + parts / 2 + 1
    share = F.col(votes) / F.col("_total")
    known = (
        parties.withColumn("_total", total)
        .withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn("_sure", F.when((F.col("_total") > 0) & (F.col("_low") > 0), F.floor(share * F.col("_low") + 0.5)).otherwise(0).cast("long"))
        .withColumn("_most", F.when(F.col("_total") > 0, F.floor(share * F.col("_high") + 0.5) + 1).otherwise(0).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_sure").over(own))
    )
    names = parties.columns
    tried = known.withColumn("_k", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1))))
    ranked = tried.withColumn("_place", F.row_number().over(own.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order], "_k")))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_place") <= F.col("_left")), 1).otherwise(0))
    return ranked.groupBy(*names, "_sure").agg(won.alias("_won")).withColumn("quota", F.col("_sure") + F.col("_won")).select(*names, "quota")


def plan_mix(docs: DataFrame, keep: list[str], source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = 42, block: int = BLOCK, ceiling: int = CEILING, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every document's ``keep`` columns with size, source_size, target and taken, and the place
    of its words in its shard: _start, and _n, _r, _o, _whole of the shard."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(source).alias("source"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), words.alias("size"))
    drawn = _drawn(F.lit(str(seed)), F.col("_id"))
    # Only sources of several shards are gathered: at most one for every shard_rows documents.
    large = rows.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).collect()
    parts = docs.sparkSession.createDataFrame([(r["source"], -(-r["n"] // shard_rows)) for r in large], "_p string, _parts long")
    known = rows.join(parts, F.col("source").cast("string").eqNullSafe(F.col("_p")), "left")
    placed = known.withColumn("_draw", drawn).withColumn("_shard", F.col("_draw") % F.coalesce("_parts", F.lit(1))).drop("_p", "_parts")
    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_words"))
    sources = targets(shards.groupBy("source").agg(F.sum("_words").alias("source_size")), ceiling)
    seats = sources.withColumn("_seats", F.floor(F.sum("source_size").over(W.partitionBy()) / block + 0.5).cast("long"))
    won = apportion(seats, [], ["source"], "target", "_seats")
    inner = shards.join(won.withColumnRenamed("quota", "_own").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_seats", "weight")
    quotas = apportion(inner, ["source"], ["_shard"], "_words", "_own")
    shaped = (
        quotas.withColumn("_n", F.ceil(F.col("_words") / block).cast("long"))
        .withColumn("_blocks", F.when(F.col("_n") > 0, F.floor(F.col("quota") * (block * F.col("_n") / F.col("_words")) + 0.5)).otherwise(0).cast("long"))
        .withColumn("_q", F.least("_blocks", F.lit(ceiling) * F.col("_n")))
        .withColumn("_whole", F.when(F.col("_n") > 0, F.expr("_q div _n")).otherwise(0))
        .withColumn("_r", F.when(F.col("_n") > 0, F.col("_q") % F.col("_n")).otherwise(0))
        .withColumn("_o", F.when(F.col("_n") > 0, _drawn(F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("_shard").cast("string")) % F.col("_n")).otherwise(0))
        .select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "source_size", "target", "_n", "_r", "_o", "_whole")
    )
    order = W.partitionBy("source", "_shard").orderBy("_draw", "_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = placed.withColumn("_end", F.sum("size").over(order)).withColumn("_start", F.col("_end") - F.col("size"))
    joined = laid.join(shaped, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h"))).withColumn("_block", F.lit(block).cast("long"))
    count = "(({0}) div _n) * _r + ((({0}) % _n) * _r) div _n"

    def taken_before(place: str) -> Column:
        at = f"({place} div _block + _o)"
        here, following, start = count.format(at), count.format(f"{at} + 1"), count.format("_o")
        return F.expr(f"({here} - ({start})) * _block + ({following} - ({here})) * ({place} % _block)")

    taken = F.when(F.col("_n") > 0, F.col("_whole") * F.col("size") + taken_before("_end") - taken_before("_start")).otherwise(0)
    return joined.withColumn("taken", taken.cast("long")).select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", "taken", "_start", "_n", "_r", "_o", "_whole", "_block"
    )


def mixed_documents(docs: DataFrame, seed: int = 42, block: int = BLOCK, ceiling: int = CEILING) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per document that has taken words,
    its text being ``_whole`` copies of the text and, once more, the words of its extra blocks.

    Documents of which no block was drawn are absent. n_chars, if there, is counted anew.
    """
    # By place, so that no column of the documents clashes with one of the plan.
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    given = docs.toDF(*place.values())
    roles = {role: place[role] for role in ("source", "text", "doc_id")}
    planned = plan_mix(given, given.columns, **roles, seed=seed, block=block, ceiling=ceiling).where("taken > 0")
    own = F.col(place["text"])
    extra = F.filter(
        F.regexp_extract_all(own, F.lit(f"({WORDS})"), 1),
        lambda _, i: F.expr("_r > 0") & _is_extra(i),
    )
    more = F.col("taken") > F.col("_whole") * F.col("size")
    copies = F.array_repeat(own, F.col("_whole").cast("int"))
    text = F.array_join(F.when(more, F.concat(copies, F.array(F.array_join(extra, " ")))).otherwise(copies), "\n")
    out = planned.withColumn(place["text"], text)
    if "n_chars" in place:
        out = out.withColumn(place["n_chars"], F.char_length(own).cast(docs.schema["n_chars"].dataType))
    return out.select(*place.values()).toDF(*docs.columns)


def _is_extra(index: Column) -> Column:
    """Whether the document's word at ``index`` lies in a block of the extra round."""
    place = F.floor((F.col("_start") + index) / F.col("_block")) + F.col("_o")

    def before(x: Column) -> Column:
        return F.floor(x / F.col("_n")) * F.col("_r") + F.floor(((x % F.col("_n")) * F.col("_r")) / F.col("_n"))

    return before(place + 1) > before(place)
