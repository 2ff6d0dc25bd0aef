"""Checks of document texts against the required shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V

_NUMBERS = ("BIGINT", "DOUBLE", "BOOLEAN", "DECIMAL")


def document_errors(root: Column, metadata_keys: Sequence[str] = V.DOC_METADATA_KEYS) -> Column:
    """All violations of one parsed document, in reading order; an empty array means valid."""

    def at(path: str) -> Column:
        return F.try_variant_get(root, f"$.{path}", "variant")

    def kind(path: str) -> Column:
        return F.schema_of_variant(at(path))

    def missing(path: str) -> Column:
        return at(path).isNull()

    def present(path: str) -> Column:
        return at(path).isNotNull()

    def numeric(path: str) -> Column:
        return F.regexp_extract(kind(path), r"^[A-Z]+", 0).isin(*_NUMBERS)

    def share(parent: str, name: str) -> list[Column]:
        path = f"{parent}.{name}"
        # True counts as 1 and False as 0 here, as in the value range check.
        number = F.coalesce(F.try_variant_get(root, f"$.{path}", "double"), F.try_variant_get(root, f"$.{path}", "boolean").cast("double"))
        return [
            F.when(present(parent), F.when(missing(path), f"Missing {path}")
                   .when(~numeric(path), f"{path} must be numeric")
                   .when(~number.between(0, 1), f"{path} must be between 0 and 1")),
        ]

    def keys(parent: str, names: Sequence[str]) -> list[Column]:
        return [F.when(present(parent) & missing(f"{parent}.{k}"), f"Missing {parent}.{k}") for k in names]

    level = F.try_variant_get(root, "$.prediction.risk_level", "string")
    items = F.try_variant_get(root, "$.explanation", "array<variant>")
    is_list = kind("explanation").startswith("ARRAY")
    bad_items = F.transform(
        F.filter(
            F.transform(items, lambda item, i: F.struct(i.alias("i"), F.schema_of_variant(item).alias("t"))),
            lambda e: F.coalesce(e["t"] != "STRING", F.lit(True)),
        ),
        lambda e: F.concat(F.lit("explanation["), e["i"].cast("string"), F.lit("] must be string")),
    )
    messages = F.array_compact(F.array(
        *[F.when(missing(k), f"Missing top-level key: {k}") for k in V.DOC_KEYS],
        *share("prediction", "flood_probability"),
        F.when(present("prediction"), F.when(missing("prediction.risk_level"), "Missing prediction.risk_level")
               .when(~F.coalesce(level.isin(*V.DOC_LEVELS), F.lit(False)), F.concat(F.lit("Invalid risk_level: "), F.coalesce(level, F.lit("None"))))),
        *share("confidence", "model_confidence"),
        F.when(present("explanation"), F.when(~is_list, "explanation must be a list").when(F.size(items) == 0, "explanation list is empty")),
    ))
    tail = F.array_compact(F.array(
        *keys("context", ("location", "time_window")),
        *[F.when(present("context.location") & missing(f"context.location.{k}"), f"Missing context.location.{k}") for k in V.DOC_LOCATION_KEYS],
        *[F.when(present("context.time_window") & missing(f"context.time_window.{k}"), f"Missing context.time_window.{k}") for k in V.DOC_WINDOW_KEYS],
        *keys("metadata", metadata_keys),
    ))
    middle = F.when(is_list, bad_items).otherwise(F.array().cast("array<string>"))
    return F.when(root.isNull(), F.array(F.lit("Failed to load JSON"))).otherwise(
        F.concat(messages, F.coalesce(middle, F.array().cast("array<string>")), tail)
    )


def check_documents(documents: DataFrame, text: str = "json", metadata_keys: Sequence[str] = V.DOC_METADATA_KEYS) -> DataFrame:
    """Add errors and is_valid; the text is parsed once and every check reads the parsed value."""
    parsed = documents.withColumn("_doc", F.try_parse_json(F.col(text)))
    checked = parsed.withColumn("errors", document_errors(F.col("_doc"), metadata_keys)).drop("_doc")
    return checked.withColumn("is_valid", F.size("errors") == 0)


def check_report(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("is_valid").alias("valid_files"),
        F.count_if(~F.col("is_valid")).alias("invalid_files"), (F.count_if(~F.col("is_valid")) == 0).alias("valid"),
    )


def require_valid(documents: DataFrame, text: str = "json", metadata_keys: Sequence[str] = V.DOC_METADATA_KEYS) -> DataFrame:
    """Fail the job when it meets an invalid document."""
    errors = F.col("errors")
    return check_documents(documents, text, metadata_keys).withColumn(
        text, F.when(F.size(errors) > 0, F.raise_error(F.array_join(errors, "; ")).cast("string")).otherwise(F.col(text))
    ).drop("errors", "is_valid")
