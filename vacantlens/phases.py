"""The three phases as runs over stored tables: extract, clean, transform.

Every run is incremental: it skips what earlier runs stored, so repeating one adds nothing.
A store is a folder of committed tables: what a run adds to several of them shows up at once, and a
run that was killed and is repeated leaves the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vacantlens import config
from vacantlens.functions.parsing import parse_academic, parse_posting_id
from vacantlens.operators import clean, enrich, features, maintain, match, topics
from vacantlens.operators.filters import missing_fields, outcome
from vacantlens.operators.incremental import keep_first, pending_keys
from vacantlens.session import scratch_path, stored
from vacantlens.sources import pages as page_source
from vacantlens.sources.committed import CommittedTables
from vacantlens.sources.sinks import refresh_enriched

TITLE_COLUMNS = ["isco_code"]
INSTITUTION_COLUMNS = ["ejecutora", "ejecutora_nombre", "nivel_gobierno", "sector", "pliego", "sec_ejec"]
PROGRAM_COLUMNS = ["programa_codigo", "campo_detallado_codigo"]


@dataclass
class Store:
    """Names of the tables of one store."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def tables(self, spark: SparkSession) -> CommittedTables:
        return CommittedTables(spark, self.root)

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        """The table, or None when no run has written it yet."""
        return self.tables(spark).read(name)


def _known_ids(spark: SparkSession, store: Store, *names: str) -> DataFrame | None:
    found = [t.select("posting_unique_id") for t in (store.read(spark, n) for n in names) if t is not None]
    if not found:
        return None
    out = found[0]
    for table in found[1:]:
        out = out.unionByName(table)
    return out


def _outcomes() -> list[Column]:
    return [F.count_if(F.col("outcome") == name).alias(name) for name in ("complete", "incomplete")]


def _statistics(seen: Observation, routed: Observation) -> dict[str, int]:
    """What a run met and stored, counted while its rows were written."""
    counts = {**seen.get, **routed.get}
    counts["duplicate"] = counts["encountered"] - counts["complete"] - counts["incomplete"] - counts["failed"]
    return counts


def extract(spark: SparkSession, pages: DataFrame, store: Store) -> dict[str, int]:
    """Stored pages (url, html, scraped_at) to raw postings; incomplete ones go to review.

    Returns how many were encountered, complete, incomplete, failed (no id) and duplicate.
    """
    seen, routing = Observation(), Observation()
    fields = page_source.posting_fields(pages, "html", ["scraped_at"]).observe(
        seen, F.count(F.lit(1)).alias("encountered"), F.count_if(F.col("posting_unique_id").isNull()).alias("failed")
    )
    fields = fields.where(F.col("posting_unique_id").isNotNull())
    known = _known_ids(spark, store, "extracted_jobs", "extracted_jobs_incomplete")
    rows = keep_first(fields, ["posting_unique_id"], ["scraped_at", *config.FIELD_ORDER[1:]])
    if known is not None:
        rows = rows.join(known, "posting_unique_id", "left_anti")
    routed = rows.withColumn("outcome", outcome("posting_unique_id", config.FIELD_ORDER)).withColumn(
        "missing_fields", F.concat_ws(", ", missing_fields(config.FIELD_ORDER))
    )
    # Written once, so that both tables come from one pass over the pages.
    staged = scratch_path(spark, "extracted")
    routed.observe(routing, *_outcomes()).write.parquet(staged)
    routed = spark.read.parquet(staged)
    complete = routed.where(F.col("outcome") == "complete").drop("outcome", "missing_fields")
    run = store.tables(spark).run()
    run.append("extracted_jobs", complete)
    review = routed.where(F.col("outcome") == "incomplete").drop("outcome").withColumns(
        {
            "reviewed": F.lit(False),
            "manually_fixed_fields": F.lit(None).cast("string"),
            "notes": F.lit(None).cast("string"),
            "reviewed_at": F.lit(None).cast("timestamp"),
        }
    )
    run.append("extracted_jobs_incomplete", review)
    run.commit()
    return _statistics(seen, routing)


def clean_new(spark: SparkSession, store: Store) -> dict[str, int]:
    """Raw postings not cleaned before, to the cleaned table and its quarantine. Without raw postings
    there is nothing to do. Returns the same counts as ``extract``."""
    raw = store.read(spark, "extracted_jobs")
    if raw is None:
        return dict.fromkeys(("encountered", "failed", "complete", "incomplete", "duplicate"), 0)
    seen, routing = Observation(), Observation()
    no_id = parse_posting_id(F.col("posting_unique_id")).isNull()
    raw = raw.observe(seen, F.count(F.lit(1)).alias("encountered"), F.count_if(no_id).alias("failed"))
    known = _known_ids(spark, store, "cleaned_jobs", "cleaned_jobs_incomplete")
    split = stored(clean.clean_split(raw, known, ["scraped_at"]).drop("scraped_at").observe(routing, *_outcomes()), "cleaned")
    run = store.tables(spark).run()
    for outcome_, name in (("complete", "cleaned_jobs"), ("incomplete", "cleaned_jobs_incomplete")):
        run.append(name, split.where(F.col("outcome") == outcome_).drop("outcome"))
    run.commit()
    return _statistics(seen, routing)


def match_new(
    spark: SparkSession, store: Store, name: str, key: str, catalog: DataFrame, code: str, text: str,
    columns: list[str], levels: bool = False, k: int = 5, version: str = "", encode: features.Encoder | None = None,
) -> DataFrame:
    """Score keys of the cleaned table that were not scored before, and return the refreshed candidate
    table, committed as ``name + version`` together with the keys it has now been scored for.

    A key without candidates counts as scored and is not tried again. The semantic score comes from the
    stored features of both texts, computed by ``encode`` for texts not seen before.
    """
    tables = store.tables(spark)
    known, scored = tables.read(name), tables.read(name + "_keys")
    cleaned = tables.read("cleaned_jobs")
    fresh_keys = pending_keys(cleaned, scored if scored is not None else cleaned.limit(0), key)
    # The keys are fixed before their features and candidates are stored.
    keys = stored(fresh_keys, "keys")
    encode = encode or features.hashed_words()
    # Without a catalog position, ties go by code.
    ordered = catalog if "position" in catalog.columns else catalog.withColumn("position", F.lit(0))
    asked = features.with_features(keys, key, tables, "features", encode, "_features")
    if levels:
        asked = asked.withColumn("search_levels", parse_academic(F.col(key))["search_levels"])
    found = match.match_topk(
        asked, features.with_features(ordered, text, tables, "features", encode, "_features"), key, code, "position",
        key_text=key, catalog_text=text, key_vector="_features", catalog_vector="_features", k=k,
        level="academic_level" if levels else None, search_levels="search_levels" if levels else None,
    )
    attributes = keep_first(catalog, [code], [text])
    fresh = match.candidate_table(found, attributes, code, [c for c in columns if c != code])
    table = fresh if known is None else maintain.refresh_candidates(known, fresh, key, code)
    run = tables.run()
    run.replace(name + version, table)
    run.append(name + "_keys", keys)
    run.commit()
    return tables.read(name + version)


def transform(
    spark: SparkSession, store: Store, titles: DataFrame, institutions: DataFrame, programs: DataFrame,
    fitted_topics: int = config.TOPICS, iterations: int = config.TOPIC_ITERATIONS,
) -> DataFrame:
    """Cleaned postings and three candidate tables to the enriched table with topic weights."""
    cleaned = store.read(spark, "cleaned_jobs")
    best = [
        enrich.best_candidates(titles, "job_title", "isco_code", TITLE_COLUMNS),
        enrich.best_candidates(institutions, "institution", "ejecutora", INSTITUTION_COLUMNS),
        enrich.best_candidates(programs, "academic_profile", "programa_codigo", PROGRAM_COLUMNS),
    ]
    weights = None
    for column, blank in (("knowledge", False), ("competencies", True), ("specialization", True)):
        texts = topics.topic_text(cleaned, "posting_unique_id", column, blank)
        model = topics.fit_topics(texts, fitted_topics, iterations)
        topics.save_topics(model, store.path(f"models/{column}"))
        found = topics.topic_features(model, texts, "posting_unique_id", column)
        weights = found if weights is None else weights.join(found, "posting_unique_id")
    enriched = enrich.enrich(cleaned, *best, topics=weights)
    refresh_enriched(stored(enriched, "enriched"), store.path("transformed_jobs"), sort=["isco_code", "ejecutora"])
    return spark.read.parquet(store.path("transformed_jobs"))
