"""Several tables that change together: versioned folders and one commit that makes them visible.

A run writes its rows to folders of its own and then one small commit file that lists the folders of
every table. Readers take the newest commit, so what a run wrote shows up whole or not at all. A run
that was killed left folders that no commit lists; done again under its name it changes nothing twice, because a
commit keeps the names of all runs. Two runs that end at once cannot both write the same commit number: the
later one fails and is repeated on top of the other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "number long, run string, name string, folder string"
#: Name of the rows of a commit that keep the runs.
_RUN = "<run>"


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@dataclass
class CommittedTables:
    """The tables under one folder that every executor can reach."""

    spark: SparkSession
    root: str

    def _path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def _newest(self) -> tuple[int, set[str], dict[str, list[str]]]:
        """(number, runs, folders of each table) of the newest commit; a row per folder and run."""
        try:
            rows = self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(self._path("_commits"))
            last = rows.agg(F.max("number")).first()[0]
        except AnalysisException as error:
            if not _missing(error):
                raise
            last = None
        if last is None:
            return 0, set(), {}
        runs, tables = set(), {}
        for row in rows.where(F.col("number") == last).orderBy("name", "folder").collect():
            if row["name"] == _RUN:
                runs.add(row["run"])
            else:
                tables.setdefault(row["name"], []).append(row["folder"])
        return last, runs, tables

    def read(self, name: str) -> DataFrame | None:
        """The table as last committed, None if no run has."""
        folders = self._newest()[2].get(name)
        return self.spark.read.option("mergeSchema", "true").parquet(*[self._path(f) for f in folders]) if folders else None

    def run(self, name: str | None = None) -> Run:
        """A run with a name that stands for the same work whenever it is repeated."""
        return Run(self, name or uuid.uuid4().hex)


@dataclass
class Run:
    """Rows written by one run, not visible before ``commit``."""

    tables: CommittedTables
    name: str
    _added: dict[str, list[str]] = field(default_factory=dict)
    _replaced: set[str] = field(default_factory=set)

    def done(self) -> bool:
        """Whether a run of this name was committed."""
        return self.name in self.tables._newest()[1]

    def append(self, table: str, rows: DataFrame) -> None:
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(self.tables._path(folder))
        self._added.setdefault(table, []).append(folder)

    def replace(self, table: str, rows: DataFrame) -> None:
        """The table will hold these rows alone."""
        self._added.pop(table, None)
        self.append(table, rows)
        self._replaced.add(table)

    def commit(self) -> bool:
        """Make all of the run visible; False if a run of its name already is."""
        number, runs, tables = self.tables._newest()
        if self.name in runs:
            return False
        for table, folders in self._added.items():
            tables[table] = folders if table in self._replaced else tables.get(table, []) + folders
        rows = [(number + 1, self.name, name, folder) for name, folders in tables.items() for folder in folders]
        rows += [(number + 1, run, _RUN, "") for run in [*runs, self.name]]
        one = self.tables.spark.createDataFrame(rows, _SCHEMA).coalesce(1)
        one.write.mode("errorifexists").parquet(self.tables._path("_commits", f"{number + 1:012d}"))
        return True
