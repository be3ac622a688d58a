"""Record model and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("label", T.StringType())])
RECORD = T.StructType([T.StructField("record_idx", T.LongType()), T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(SPAN)), T.StructField("split", T.StringType())])

# The labels in ontology order.
LABELS = (
    "PERSON_NAME", "DOB", "AGE", "SSN", "ITIN", "TAX_ID", "EMAIL", "PHONE", "STREET_ADDRESS", "CITY", "STATE_PROVINCE", "POSTAL_CODE", "COUNTRY",
    "CREDIT_CARD_NUMBER", "BANK_ACCOUNT_NUMBER", "ROUTING_NUMBER", "IBAN", "SWIFT_BIC", "BUSINESS_ID", "PASSPORT_NUMBER", "DRIVER_LICENSE", "IP_ADDRESS",
    "DEVICE_ID", "AUTH_TOKEN", "API_KEY",
)
# Labels whose leak is critical.
HIGH_RISK = ("SSN", "ITIN", "TAX_ID", "CREDIT_CARD_NUMBER", "BANK_ACCOUNT_NUMBER", "ROUTING_NUMBER", "IBAN", "AUTH_TOKEN", "API_KEY", "PASSPORT_NUMBER", "DRIVER_LICENSE")
# Mask action by label; every other label is MASK.
MASK_ACTIONS = {"SSN": "MASK_LAST4", "CREDIT_CARD_NUMBER": "MASK_LAST4", "AUTH_TOKEN": "FULL_MASK", "API_KEY": "FULL_MASK", "PERSON_NAME": "FULL_MASK", "EMAIL": "PARTIAL_MASK", "PHONE": "PARTIAL_MASK"}
# Review states that are accepted.
REVIEW_STATES = ("auto_converted", "synthetic_generated", "manual_reviewed", "pseudolabeled_reviewed")
# Older names of review states, accepted with a warning.
LEGACY_REVIEW_STATES = ("generated",)
# Source labels that are left for later, belong to health care, or are harmless.
DEFERRED, HEALTHCARE, BENIGN = "deferred_ml_v1", "healthcare_extension", "benign_unmapped"


def label_dim(spark: SparkSession) -> DataFrame:
    """label(label_ord, label, high_risk, mask_action): 25 rows."""
    rows = [(i, x, x in HIGH_RISK, MASK_ACTIONS.get(x, "MASK")) for i, x in enumerate(LABELS)]
    return spark.createDataFrame(rows, "label_ord int, label string, high_risk boolean, mask_action string")


def bio_dim(spark: SparkSession) -> DataFrame:
    """bio(id, tag, label): outside is 0, then B- and I- of each label in turn; 51 rows."""
    rows = [(0, "O", None)]
    for i, x in enumerate(LABELS):
        rows += [(1 + 2 * i, f"B-{x}", x), (2 + 2 * i, f"I-{x}", x)]
    return spark.createDataFrame(rows, "id int, tag string, label string")
