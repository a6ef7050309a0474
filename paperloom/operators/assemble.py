"""Gates, errors, responses and their sinks.

Defined results: a size that is not known is refused by no limit and admitted by none; of a document's errors that of the earliest
gate stays, then the least parameters; documents without a doc_id match nothing; repeated rows count once where one is chosen and are
kept elsewhere; empty tables give no rows, and sinks without any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Error codes, their status and their parameters' names and types.
CATALOGUE = (
    ("NOT_FOUND", 404, {}),
    ("VALIDATION_FAILED", 422, {}),
    ("INTERNAL_ERROR", 500, {}),
    ("SKILL_VALIDATION_FAILED", 500, {"file": "string", "reason": "string"}),
    ("SKILL_NOT_FOUND", 404, {"name": "string", "version": "string"}),
    ("PDF_INVALID", 400, {}),
    ("PDF_PASSWORD_PROTECTED", 400, {}),
    ("PDF_TOO_MANY_PAGES", 413, {"limit": "integer", "actual": "integer"}),
    ("PDF_NO_TEXT_EXTRACTABLE", 422, {}),
    ("INTELLIGENCE_UNAVAILABLE", 503, {}),
    ("STRUCTURED_OUTPUT_FAILED", 502, {}),
    ("INTELLIGENCE_TIMEOUT", 504, {"budget_seconds": "number"}),
    ("EXTRACTION_BUDGET_EXCEEDED", 504, {"budget_seconds": "number"}),
    ("PDF_TOO_LARGE", 413, {"max_bytes": "integer", "actual_bytes": "integer"}),
    ("PDF_PARSER_UNAVAILABLE", 500, {"dependency": "string"}),
    ("EXTRACTION_OVERLOADED", 503, {"max_concurrent": "integer"}),
)
#: Which gate is passed first.
GATES = ("VALIDATION_FAILED", "PDF_TOO_LARGE", "SKILL_NOT_FOUND", "PDF_INVALID", "PDF_PASSWORD_PROTECTED", "PDF_TOO_MANY_PAGES", "PDF_NO_TEXT_EXTRACTABLE", "STRUCTURED_OUTPUT_FAILED")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "code string, http_status int, params map<string,string>")


def admitted(docs: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Documents up to the limit, and ``doc_id, max_bytes, actual_bytes`` of larger ones."""
    large = F.col("n_bytes") > max_bytes
    return docs.where(~large), docs.where(large).select("doc_id", F.lit(max_bytes).alias("max_bytes"), F.col("n_bytes").alias("actual_bytes"))


def all_failed(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents without any extracted field, or without fields."""
    any_of = fields.groupBy("doc_id").agg(F.bool_or(F.col("status") == "extracted").alias("some"))
    rows = requests.select("doc_id").join(any_of, "doc_id", "left").where(~F.coalesce("some", F.lit(False)))
    return rows.select("doc_id", F.lit("STRUCTURED_OUTPUT_FAILED").alias("code"))


def first_errors(*gates: DataFrame) -> DataFrame:
    """One error for each document, that of the earliest gate: ``doc_id, code, params``. ``gates`` have doc_id, code and maybe params."""
    stage = F.array_position(F.array(*map(F.lit, GATES)), F.col("code"))
    rows = None
    for gate in gates:
        params = F.col("params") if "params" in gate.columns else F.lit(None).cast("map<string,string>")
        part = gate.select("doc_id", "code", params.alias("params"), stage.alias("stage"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("code", "params"), F.struct("stage", F.to_json("params"))).alias("e")).select("doc_id", "e.code", "e.params")


def error_rows(errors: DataFrame, codes: DataFrame) -> DataFrame:
    """Dead letters: errors with their status and a request id made of the document. The catalogue has a row for each code."""
    rows = errors.join(F.broadcast(codes.select("code", "http_status")), "code")
    return rows.select("doc_id", "code", "http_status", "params", F.md5(F.concat(F.lit("request:"), F.col("doc_id").cast("string"))).alias("request_id"))


def responses(requests: DataFrame, fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Nested responses: fields by name in declared order, and what is known of the run."""
    value = F.struct("value", "status", "source", "grounded", "bbox_refs")
    rows = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field_pos", "field_name", value.alias("field"), "attempts"))).alias("f"))
    by_name = F.map_from_entries(F.transform("f", lambda x: F.struct(x["field_name"], x["field"])))
    attempts = F.map_from_entries(F.transform("f", lambda x: F.struct(x["field_name"], F.coalesce(x["attempts"], F.lit(1)))))
    meta = F.struct("page_count", "duration_ms", attempts.alias("attempts_per_field"), F.array().cast("array<string>").alias("parser_warnings"))
    return requests.join(rows, "doc_id").join(docs.select("doc_id", "page_count", "duration_ms"), "doc_id").select("doc_id", "skill_name", F.col("version").alias("skill_version"), "output_mode", by_name.alias("fields"), meta.alias("metadata"))


def metadata(requests: DataFrame, fields: DataFrame, docs: DataFrame) -> DataFrame:
    """The metadata in long form: a row for each declared field."""
    return requests.select("doc_id").join(fields, "doc_id").join(docs.select("doc_id", "page_count"), "doc_id").select("doc_id", "page_count", "field_name", F.coalesce("attempts", F.lit(1)).alias("attempts"))


def summary(fields: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return fields.groupBy(*keys).agg(F.count_if(F.col("status") == "extracted").alias("n_extracted"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def by_mode(rows: DataFrame) -> DataFrame:
    """``rows`` with what their output mode asks for: json, annotation or both."""
    mode = F.col("output_mode")
    parts = F.when(mode == "JSON_ONLY", F.array(F.lit("json"))).when(mode == "PDF_ONLY", F.array(F.lit("annotation"))).when(mode == "BOTH", F.array(F.lit("json"), F.lit("annotation")))
    return rows.withColumn("part", F.explode(parts))


#: What a run leaves, and the format of each.
SINKS = {"responses": "json", "fields": "parquet", "highlights": "parquet", "errors": "parquet"}


def write(path: str, batch: int, nested: DataFrame, fields: DataFrame, boxes: DataFrame, errors: DataFrame) -> None:
    """Each table to its own place, and a batch to its own folder there: responses whose mode has json as JSON, boxes of those whose mode
    has an annotation, the fields by status and the errors as Parquet. A batch that is written again replaces what it wrote before,
    rows or none, and leaves others alone."""
    own = nested.select("doc_id", "output_mode")
    tables = {
        "responses": nested.where("output_mode <> 'PDF_ONLY'"),
        "highlights": boxes.join(own.where("output_mode <> 'JSON_ONLY'").select("doc_id"), "doc_id", "left_semi"),
        "fields": fields.join(own.select("doc_id"), "doc_id", "left_semi"),
        "errors": errors,
    }
    for name, rows in tables.items():
        out = rows.write.mode("overwrite").format(SINKS[name])
        (out.partitionBy("status") if name == "fields" else out).save(f"{path}/{name}/batch={batch}")


def read(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """A sink's rows, as ``schema`` has them, with their ``batch``; what is asked of batches, or of the fields' status, prunes folders."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).format(SINKS[name]).load(f"{path}/{name}")


def validation_details(problems: DataFrame) -> DataFrame:
    """``doc_id, details`` (field, reason; a field is its path joined by arrows) of ``problems`` (doc_id, path, reason)."""
    detail = F.struct(F.array_join("path", " -> ").alias("field"), "reason")
    return problems.groupBy("doc_id").agg(F.array_sort(F.collect_list(detail)).alias("details"))
