"""A training corpus in five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns
of ``docs``.

Edge cases: a null text counts as empty, is no one's copy and stays, with nothing
taken of it; a null id is not fitted on, and its row is judged by its text; of rows
with equal ids and texts all stay or none; other columns travel along, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, mixing, neardup, secrets, toxicity
from nearfield.llm.common import dropped, dropped_since, load, working, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.kept(docs, toxicity.fitted(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return neardup.deduplicated(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.kept(docs, load(spark, sf_dir, "benchmark"))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts, and ``n_chars`` follows; copied examples and all documents stay."""
    return secrets.redacted(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mixing.result(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", contaminated),
    ("secrets", secret_values),
    ("mixing", mix),
]
#: SQL has no word for the fitted model and the balanced sample.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again."""
    docs, last = load(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        before = working()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped_since(before, but=docs)
        dropped(*last)
        last = (docs,)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
