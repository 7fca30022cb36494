"""From recorded candidates to training rows, in two stored stages.

Stage one: filter list, deduplication, a run of every distinct query, scores
and schema texts; the scored table is written.
Stage two: sample, cap per question, points, prompt, split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import catalog, curation, execution, sampling, scoring
from ..session import write_and_read

SCORES = ["label", "syntax_check", "schema_linking", "ngram_jaccard"]
SCORED_ROW = ["cand_id", "db_id", "question", "evidence", "gold_query", "generated_query", "schema", *SCORES,
              "formatted_result"]


def with_ordinals(columns: DataFrame) -> DataFrame:
    """``columns`` with a place in their table: the catalog's, or by name where it gives none."""
    if "ordinal" in columns.columns:
        return columns
    return columns.withColumn("ordinal", F.row_number().over(
        Window.partitionBy("db_id", "table_name").orderBy("column_name")))


def schemas(queries: DataFrame, columns: DataFrame, keys: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """``db_id, query, schema_text``: the tables and columns that each distinct query names, with remarks from the
    profile.  Jobs run while this is called."""
    placed = with_ordinals(columns)
    resolved = catalog.stored_keys(keys, placed)
    metadata = catalog.enriched(placed, resolved, profile=profile) if profile is not None else None
    return catalog.schema_text(scoring.columns_by_table(queries, columns), placed, resolved, metadata, by=("query",))


def with_schemas(rows: DataFrame, texts: DataFrame, query: str = "generated_query") -> DataFrame:
    """Adds ``schema`` from :func:`schemas`, null where the query names nothing.

    Joined by a digest of the query, which leaves one that many rows share to
    Spark's skew join.
    """
    named = texts.select(execution.text_id("query").alias("_id"), F.col("schema_text").alias("schema"))
    return rows.withColumn("_id", execution.text_id(query)).join(named, "_id", "left").drop("_id")


def scored_rows(candidates: DataFrame, columns: DataFrame, keys: DataFrame, tables: execution.Tables,
                filter_list: DataFrame | None = None, profile: DataFrame | None = None,
                by: tuple[str, ...] = ("db_id", "question"),
                order: tuple[str, ...] = ("source_model", "cand_id")) -> DataFrame:
    """Distinct candidates as :data:`SCORED_ROW`: every query is run, which gives its syntax check and its preview.

    ``label`` comes with the rows.  Jobs run while this is called.
    """
    rows = curation.drop_listed(candidates, filter_list) if filter_list is not None else candidates
    distinct = write_and_read(curation.dedup_candidates(rows, list(by), list(order)), "distinct")
    queries = write_and_read(scoring.distinct_queries(distinct), "queries")
    results = execution.run_queries(distinct.sparkSession, queries, tables, with_preview=True)
    run = execution.with_results(distinct, write_and_read(results, "results"))
    parsed = F.col("syntax_check") >= 1.0
    scored = scoring.ngram_jaccard(scoring.schema_recall(run, columns, parsed))
    return with_schemas(scored, schemas(queries, columns, keys, profile)).select(*SCORED_ROW)


def training_rows(scored: DataFrame, fraction: float = 0.5, per_question: int = 5, test_share: float = 0.01,
                  seed: int = 42, template: str = "score_query") -> DataFrame:
    """Sampled, capped and rendered rows with their points and their split.

    Rows without points, whose gold query names nothing, teach nothing and go.
    The split is by the question's text, so that one text is never on both
    sides, whatever its database.
    """
    points = scoring.composite(*[F.col(c) for c in SCORES])
    kept = sampling.sample_fraction(scored, ["cand_id"], fraction, seed)
    capped = (sampling.cap_per_group(kept, ["db_id", "question"], ["cand_id"], per_question, seed)
              .withColumn("answer", points).filter(F.col("answer").isNotNull()))
    prompt = prompts.render(prompts.load_template(template), {
        "DATABASE_SCHEMA": F.col("schema"), "QUESTION": F.col("question"), "HINT": F.col("evidence"),
        "SQL": F.col("generated_query"), "RESULTS": F.col("formatted_result")})
    short = sampling.short_enough(capped.withColumn("user_prompt", prompt), "user_prompt")
    return sampling.split(short, ["question"], test_share, seed).select(
        "cand_id", "db_id", "question", "evidence", "gold_query", "answer",
        prompts.encode_messages(prompts.messages(F.col("user_prompt"))).alias("prompt"), "split")


def run(candidates: DataFrame, columns: DataFrame, keys: DataFrame, filter_list: DataFrame,
        tables: execution.Tables, profile: DataFrame | None = None) -> DataFrame:
    return training_rows(write_and_read(scored_rows(candidates, columns, keys, tables, filter_list, profile), "scored"))
