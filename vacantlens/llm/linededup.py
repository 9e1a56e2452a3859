"""Repeated lines, found with levelled sorted runs of line hashes. DataFrame functions only.

A line's key is the line without blanks at both ends, A-Z in lower case. A batch of documents
is counted by key hash, then merge-anti-joined against the runs, which know the hashes that have
reached the threshold: those need no more counting. What is left is added as a run of level 0,
sorted by hash. When a level holds ``FANOUT`` runs they are merged into one run of the next
level, so a hash lies in few runs however many batches there were. Runs live in the shared
scratch folder.

Defined cases: a null or empty text is one empty line; an empty key is never counted when
``least_chars`` is 1 or more; rows that repeat a doc_id are separate documents, each counted;
an empty table gives an empty result; further columns of any name are kept, but for _lines and
_dropped, which are made anew. The work of a document is linear in its lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.llm.columns import once
from vacantlens.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Batches of one call, runs per level before they are merged.
BATCHES, FANOUT = 3, 3


def line_key(line: Column) -> Column:
    """The line stripped of blanks, A-Z lower-cased and no other letter changed."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is much faster and equal on ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    """128 bits: two seeded hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


@dataclass
class LineRuns:
    """The levelled runs: each a table (h1, h2, n) sorted by hash within its files, n documents."""

    spark: SparkSession
    least_docs: int
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def totals(self) -> DataFrame | None:
        runs = self.runs()
        if not runs:
            return None
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame | None:
        """Hashes of the keys that reached the threshold."""
        totals = self.totals()
        return None if totals is None else totals.where(F.col("n") >= self.least_docs).select("h1", "h2")

    def _run(self, counts: DataFrame) -> DataFrame:
        return stored(counts.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "run")

    def add(self, counts: DataFrame) -> None:
        """One batch: (h1, h2, n). Hashes known as frequent are left out, the rest is a new run."""
        known = self.frequent()
        fresh = counts if known is None else counts.join(known, ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._run(fresh))
        level = 0
        while len(self.levels[level]) >= FANOUT:
            merged = reduce(DataFrame.unionByName, self.levels[level]).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
            self.levels[level] = []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._run(merged))
            level += 1


def count_lines(docs: DataFrame, text: str = "text", least_chars: int = 1) -> DataFrame:
    """(h1, h2, n): in how many documents each line key stands."""
    keys = F.array_distinct(F.transform(_lines(F.col(text)), line_key))
    counted = docs.select(F.explode(keys).alias("key")).where(F.char_length("key") >= least_chars)
    return counted.select(_hash(F.col("key")).alias("h")).groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n"))


def drop_repeated_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the lines of keys found in ``least_docs`` documents or more
    taken out of ``text``, and _lines and _dropped: how many there were and how many went."""
    runs = LineRuns(docs.sparkSession, least_docs)
    # The hashed lines are made once; a batch is a folder of them.
    seeded = docs.select(
        F.pmod(F.xxhash64(F.lit("batch"), F.col(doc_id), F.col(text)), F.lit(batches)).cast("int").alias("batch"),
        F.xxhash64(F.lit("row"), F.col(doc_id), F.col(text)).alias("r1"),
        F.xxhash64(F.col(text), F.col(doc_id)).alias("r2"),
        F.transform(_lines(F.col(text)), lambda line: _keyed(line, least_chars)).alias("lines"),
    )
    hashed = stored(seeded, "lines")
    for batch in range(batches):
        # Each key once per document: array_distinct compares all pairs of structs, neighbours in order are few.
        ordered = once(hashed.where(F.col("batch") == batch), "ordered", F.sort_array("lines"))
        first = F.filter("ordered", lambda h, i: ~h.eqNullSafe(F.get("ordered", i - 1)))
        part = ordered.select(F.explode(first).alias("h")).where("h IS NOT NULL")
        runs.add(part.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n")))
    frequent = runs.frequent()
    assert frequent is not None
    places = hashed.select("r1", "r2", F.posexplode("lines").alias("pos", "h")).where("h IS NOT NULL").select("r1", "r2", "pos", "h.h1", "h.h2")
    hit = places.join(frequent, ["h1", "h2"]).groupBy("r1", "r2").agg(F.collect_set("pos").alias("_gone"))
    # A row of any columns travels as one, so that none of its names can clash.
    rows = docs.select(
        F.xxhash64(F.lit("row"), F.col(doc_id), F.col(text)).alias("r1"), F.xxhash64(F.col(text), F.col(doc_id)).alias("r2"), F.struct("*").alias("row")
    )
    out = once(rows.join(hit, ["r1", "r2"], "left"), "lines", _lines(F.col("row").getField(text)))
    # Places as a set difference: linear in the lines, however many go.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce(F.col("row").getField(text), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    )
    added = {"_lines": F.size("lines").cast("long"), "_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    own = [kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return out.select(*own, *[value.alias(name) for name, value in added.items()])


def _keyed(line: Column, least_chars: int) -> Column:
    key = line_key(line)
    return F.when(F.char_length(key) >= least_chars, _hash(key))
