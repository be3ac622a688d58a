"""Label contracts and prediction caches."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import closed_aliases
from ..schema import LABELS


def load_ontology(path: str) -> list[str]:
    """The labels of a JSON object {entities: [...], bio_labels?, label_to_id?, id_to_label?} after its checks: not empty, no tags for labels, no label twice, tags and ids in the order of the labels."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    labels = told.get("entities") if isinstance(told, dict) else None
    problems = []
    if not isinstance(labels, list) or not labels:
        raise ValueError("no labels")
    if any(not isinstance(x, str) or not x.strip() for x in labels):
        raise ValueError("a label that is no name")
    if any(x.startswith(("B-", "I-")) or x == "O" for x in labels):
        problems.append("tags among the labels")
    if len(set(labels)) != len(labels):
        problems.append("a label twice")
    tags = ["O", *[f"{p}-{x}" for x in labels for p in "BI"]]
    want = {"bio_labels": tags, "label_to_id": {x: i for i, x in enumerate(tags)}, "id_to_label": {str(i): x for i, x in enumerate(tags)}}
    want["id2label"] = want["id_to_label"]
    problems += [f"{k} does not follow the labels" for k, v in want.items() if told.get(k, v) != v]
    if problems:
        raise ValueError("; ".join(problems))
    return labels


def contract_gaps(labels: list[str]) -> dict[str, list[str]]:
    """What is missing from, or foreign to, the ontology."""
    return {"missing": [x for x in LABELS if x not in labels], "foreign": [x for x in labels if x not in LABELS]}


# Source labels that a policy without lists of its own leaves for later, gives to health care, or lets pass.
DEFERRED_LABELS = ("PASSWORD", "PIN", "OTP", "SECURITY_ANSWER", "JWT", "SESSION_ID", "COOKIE", "CVV", "CARD_EXPIRY", "MAC_ADDRESS", "GEOLOCATION", "BIOMETRIC_ID")
HEALTHCARE_LABELS = ("PROVIDER_NPI", "MRN", "PATIENT_ID", "HEALTH_PLAN_ID", "CLAIM_ID", "PRESCRIPTION_ID", "DIAGNOSIS_CODE", "PROCEDURE_CODE", "LAB_ORDER_ID")
BENIGN_LABELS = ("DATE", "TIME", "DATE_TIME", "COMPANY", "ORGANIZATION", "ORGANIZATION_NAME", "JOB")


def _key(label: str) -> str:
    return re.sub(r"[\s\-./]+", "_", label.strip()).strip("_").upper()


def _names(told: object, field: str) -> dict[str, str | None]:
    """A mapping of names by their keys; a key told twice with another name is an error."""
    if not isinstance(told, dict):
        raise ValueError(f"{field} is no mapping")
    out: dict[str, str | None] = {}
    for k, v in told.items():
        if not isinstance(k, str) or not k.strip() or not (v is None or isinstance(v, str)):
            raise ValueError(f"{field} maps what is no name")
        value = None if v is None else _key(v)
        if out.get(_key(k), value) != value:
            raise ValueError(f"two values for {_key(k)}")
        out[_key(k)] = value
    return out


def policy(mapping: dict | None = None, aliases: dict | None = None, subtypes: dict | None = None, deferred: list | None = None, healthcare: list | None = None, benign: list | None = None) -> dict:
    """A label policy: mapping (source label to label, None to leave it out), aliases (chains closed), subtypes (source label to subtype) and the sets deferred, healthcare and benign, the fixed ones
    where none is given. All keys are in upper case with _ between words."""
    sets = {"deferred": (deferred, DEFERRED_LABELS), "healthcare": (healthcare, HEALTHCARE_LABELS), "benign": (benign, BENIGN_LABELS)}
    closed = closed_aliases({k: v for k, v in _names(aliases or {}, "aliases").items() if v is not None})
    out = {"mapping": _names(mapping or {}, "mapping"), "aliases": closed, "subtypes": _names(subtypes or {}, "subtypes")}
    for name, (told, default) in sets.items():
        if told is not None and (not isinstance(told, list) or any(not isinstance(x, str) or not x.strip() for x in told)):
            raise ValueError(f"{name} is no list of names")
        out[name] = default if told is None else tuple(map(_key, told))
    return out


def load_policy(path: str, source: str | None = None) -> dict:
    """The policy of a YAML or JSON file: {mappings: {<source>: {mapping: {...}}}, normalization_aliases, source_label_aliases, deferred_labels, healthcare_extension_labels, benign_unmapped_labels};
    source: which of several mappings, the first without it."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            told = json.load(f)
        else:
            try:
                import yaml
            except ImportError as e:
                raise ValueError("a YAML policy needs PyYAML; tell it as JSON") from e
            told = yaml.safe_load(f)
    if not isinstance(told, dict):
        raise ValueError("a policy is a mapping")
    mappings = told.get("mappings")
    if not isinstance(mappings, dict) or not mappings or (source is not None and source not in mappings):
        raise ValueError("no mapping for the source")
    own = mappings[source or next(iter(mappings))]
    if not isinstance(own, dict):
        raise ValueError("the mapping of a source is a mapping")
    return policy(own.get("mapping", own), told.get("normalization_aliases"), told.get("source_label_aliases"), told.get("deferred_labels"), told.get("healthcare_extension_labels"), told.get("benign_unmapped_labels"))


def resolve_label(source_label: str, told: dict, labels: tuple[str, ...] = LABELS) -> tuple[str | None, bool]:
    """(label, whether the mapping tells it): a mapped label, else the subtype or the name itself where that is a label after aliases, else None."""
    key, end = _key(source_label), lambda x: told["aliases"].get(x, x)
    if key in told["mapping"]:
        target = told["mapping"][key]
        return (None if target is None else end(target)), True
    found = end(told["subtypes"].get(key) or key)
    return (found if found in labels else None), False


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(record_idx, pred_idx, span_start, span_end, label, confidence, min_conf) of a prediction cache: one JSON object with predictions[record][span]. Records are told by position."""
    cache = spark.read.schema("split string, predictions array<array<struct<start:int,end:int,label:string,confidence:double,minimum_token_confidence:double>>>").option("multiLine", True).json(path)
    records = cache.select(F.posexplode("predictions").alias("record_idx", "spans"))
    spans = records.select(F.col("record_idx").cast("bigint").alias("record_idx"), F.posexplode("spans").alias("pred_idx", "s"))
    return spans.select("record_idx", "pred_idx", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.label", "s.confidence", F.col("s.minimum_token_confidence").alias("min_conf"))


def parse_range(column: str) -> list:
    """Columns s and e of a '[s,e)' string; null where it is none."""
    part = lambda i: F.regexp_extract(column, r"^\[(\d+),\s*(\d+)\)$", i)
    return [F.nullif(part(1), F.lit("")).cast("int").alias("s"), F.nullif(part(2), F.lit("")).cast("int").alias("e")]
