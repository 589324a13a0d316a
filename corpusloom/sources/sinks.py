"""Sinks: contributions are united first and written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: The entity tables; all columns are strings.
ENTITIES = {
    "S_guideline": "guideline_id guidelineTitle guidelineSource guidelineDate",
    "S_recommendation": "guideline_id rec_id recommendationText",
    "S_drug": "guideline_id drug_id agentName minDose maxDose duration drugCategory",
    "S_therapy": "guideline_id therapy_id therapyType therapy_name",
    "S_condition": "guideline_id condition_id conditionName",
    "S_stage": "guideline_id stage_id stageScheme stageLevel stageName StageCriteriaText",
    "S_cause": "guideline_id cause_id causeName",
    "S_phenotype": "guideline_id phenotype_id phenotypeCode phenotypeCriteria",
    "S_assessment": "guideline_id assessment_id assessmentName assessmentValue",
    "S_adverse_event": "guideline_id ae_id adverseEventName adverseEventSeverity",
    "S_annotation_concept": "guideline_id concept_id conceptName",
}


def entity_table(spark: SparkSession, name: str, *parts: DataFrame, document: str = "guideline_unknown") -> DataFrame:
    """An entity table of all contributions: its columns, stamped with the document, empty strings for what is missing."""
    columns = ENTITIES[name].split()
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cell = lambda c: T.filled(F.col(c)) if c in rows.columns else F.lit("")
    stamp = F.when(cell("guideline_id") == "", F.lit(document)).otherwise(cell("guideline_id"))
    return rows.select(stamp.alias("guideline_id"), *(cell(c).alias(c) for c in columns[1:]))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"', emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def quarantine(tables: DataFrame, classified: DataFrame) -> DataFrame:
    """Tables without a role."""
    return tables.join(classified, "table_id", "left_anti")


def concepts(linked: DataFrame) -> DataFrame:
    """(concept_id, conceptName): one label a concept, the last by position, in the order of ids."""
    rows = linked.where(T.filled(F.col("cui")) != "")
    return rows.groupBy(F.col("cui").alias("concept_id")).agg(F.max_by("label", "pos").alias("conceptName")).orderBy("concept_id")
