"""JSON payloads in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType, StringType

from cardwatch.functions import columns as fx

CORRUPT = "_corrupt_record"


def parse_payload_json(df: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """Bytes or text -> columns. Malformed rows keep their text in ``_corrupt_record``.

    A generator makes the columns: filters on them can't be pushed below it, where every one of them would parse anew.
    """
    full = StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
               "allowNonNumericNumbers": "true"}
    parsed = F.from_json(F.col(value).cast("string"), full, options)
    return df.select(F.inline(F.array(parsed)))


def serialize_prediction_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(F.to_json(F.struct(*(columns or ["*"]))).alias("value"))


def extra_fields(value: str, known: list[str]) -> Column:
    """Fields of an open payload beyond the known ones, as a text map."""
    everything = F.from_json(F.col(value).cast("string"), "map<string,string>")
    return F.map_filter(everything, lambda k, _: ~k.isin(known))


def normalize_payload(df: DataFrame, id_col: str = "TransactionID") -> DataFrame:
    """Submission defaults: no NaN or infinity, text id, product W, UTC timestamp.

    An id that is missing is made from the message itself, so that a message that is read
    again, after a lost task or a replay, gets the same one.
    """
    reals = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    out = df.withColumns({c: fx.finite(F.col(c)) for c in reals})
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    made = F.concat(F.lit("TXN_"), F.upper(F.substring(F.sha2(content, 256), 1, 12)))
    columns = {id_col: F.coalesce(F.col(id_col).cast("string"), made)}
    if "ProductCD" in df.columns:
        columns["ProductCD"] = F.coalesce("ProductCD", F.lit("W"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    given = F.col("timestamp") if "timestamp" in df.columns else F.lit(None).cast("string")
    columns["timestamp"] = F.coalesce(given, now)
    return out.withColumns(columns)


def acceptable(amount: str = "TransactionAmt") -> Column:
    """True if an amount is present and positive."""
    return F.coalesce(F.col(amount) > 0, F.lit(False)) & ~F.isnan(F.coalesce(
        F.col(amount).cast("double"), F.lit(0.0)))


def validate_payload(df: DataFrame, amount: str = "TransactionAmt") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): an amount must be present and positive."""
    return df.where(acceptable(amount)), df.where(~acceptable(amount))


def route_topic(settings, decision: str = "decision") -> Column:
    """Output topic of a decision; anything unexpected goes to the error topic."""
    k = settings.kafka
    return (F.when(F.col(decision).isin("FRAUD", "BLOCK", "HOLD"), k.fraud_output_topic)
            .when(F.col(decision).isin("LEGITIMATE", "APPROVE", "REVIEW"), k.legit_output_topic)
            .otherwise(k.error_output_topic))


def split_by_decision(df: DataFrame) -> dict[str, DataFrame]:
    """The three routes of the two-way decision."""
    known = ("FRAUD", "LEGITIMATE")
    return {
        "fraud": df.where(F.col("decision") == "FRAUD"),
        "legit": df.where(F.col("decision") == "LEGITIMATE"),
        "error": df.where(~F.coalesce(F.col("decision").isin(*known), F.lit(False))),
    }
