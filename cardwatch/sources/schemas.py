"""Wire schemas of transactions and predictions."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType,
)

from cardwatch.functions import fixed

# Identity fields that carry text; the other id_NN are numbers.
TEXT_IDS = {12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38}


def transaction_schema(opaque: list[int] | None = None) -> StructType:
    """Nullable fields of one transaction; ``opaque`` defaults to the trained V columns."""
    number, text = DoubleType(), StringType()
    fields: list[tuple[str, object]] = [
        ("TransactionID", text), ("TransactionDT", LongType()), ("TransactionAmt", number),
        ("ProductCD", text),
        *[(f"card{i}", text if i in (4, 6) else number) for i in range(1, 7)],
        ("addr1", number), ("addr2", number), ("dist1", number), ("dist2", number),
        ("P_emaildomain", text), ("R_emaildomain", text),
        *[(f"C{i}", number) for i in range(1, 15)],
        *[(f"D{i}", number) for i in range(1, 16)],
        *[(f"M{i}", text) for i in range(1, 10)],
        *[(f"V{i}", number) for i in (fixed.OPAQUE_KEEP if opaque is None else opaque)],
        ("DeviceType", text), ("DeviceInfo", text),
        *[(f"id_{i:02d}", text if i in TEXT_IDS else number) for i in range(1, 39)],
        ("timestamp", text), ("ip_address", text),
    ]
    return StructType([StructField(n, t, True) for n, t in fields])


def identity_schema() -> StructType:
    keep = {"TransactionID", "DeviceType", "DeviceInfo"}
    return StructType([
        f for f in transaction_schema([]) if f.name in keep or f.name.startswith("id_")])


def prediction_schema() -> StructType:
    """The union of the stream record, the declared record and the synchronous reply."""
    number, text = DoubleType(), StringType()
    required = [
        ("transaction_id", text), ("fraud_probability", number), ("decision", text),
        ("risk_level", text), ("threshold", number), ("timestamp", text),
        ("TransactionAmt", number), ("ProductCD", text), ("card1", text), ("card4", text),
        ("card6", text), ("P_emaildomain", text),
    ]
    optional = [
        ("risk_factors", ArrayType(text)), ("ato_risk", number), ("ato_detected", BooleanType()),
        ("velocity_risk", number), ("amount_risk", number), ("base_threshold", number),
        ("hybrid_threshold", number),
    ]
    return StructType([StructField(n, t, False) for n, t in required]
                      + [StructField(n, t, True) for n, t in optional])
