"""Strict and tolerant reading of answers in the JSON contracts.

Spark's JSON functions accept trailing text and lose key order, so the strict
levels (syntax, schema with key order, semantics) are one Arrow batch function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordered keys of the contract and of its diagnosis.
KEYS = ("evidence_present", "evidence_region", "visible_attributes", "diagnosis", "reliability")
DIAGNOSIS_KEYS = ("status", "pest_id", "pest_name", "species", "stage")
STATUSES = ("supported", "uncertain", "abstain")
RELIABILITIES = ("supported", "insufficient_visual_evidence")

SCHEMA = "syntax boolean, schema_ok boolean, semantic boolean, error string, evidence_present boolean, region array<double>, attributes array<string>, status string, pest_id int, pest_name string, reliability string"


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def parse_answer(text: str | None, tolerant: bool = False) -> dict:
    """The fields and levels of one answer; ``error`` names the first rule it breaks."""
    out = {k: None for k in ("error", "evidence_present", "region", "attributes", "status", "pest_id", "pest_name", "reliability")} | {"syntax": False, "schema_ok": False, "semantic": False}
    if text is None:
        return out | {"error": "null"}
    if tolerant:
        a, b = text.find("{"), text.rfind("}")
        text = text[a : b + 1] if 0 <= a < b else text
    try:
        obj = json.loads(text)
    except (ValueError, RecursionError):
        return out | {"error": "syntax"}
    if not isinstance(obj, dict):
        return out | {"error": "not_object"}
    out["syntax"] = True
    if isinstance(obj.get("evidence_present"), bool):
        out["evidence_present"] = obj["evidence_present"]
    region = obj.get("evidence_region")
    if isinstance(region, list) and all(map(_number, region)):
        out["region"] = [float(v) for v in region]
    if isinstance(obj.get("visible_attributes"), list):
        out["attributes"] = [str(v) for v in obj["visible_attributes"]]
    if isinstance(obj.get("reliability"), str):
        out["reliability"] = obj["reliability"]
    d = obj.get("diagnosis")
    if isinstance(d, dict):
        out["status"] = d.get("status") if isinstance(d.get("status"), str) else None
        pest = d.get("pest_id")
        out["pest_id"] = pest if isinstance(pest, int) and not isinstance(pest, bool) and -(2**31) <= pest < 2**31 else None
        out["pest_name"] = d.get("pest_name") if isinstance(d.get("pest_name"), str) else None
    if list(obj) != list(KEYS):
        return out | {"error": "keys"}
    if not isinstance(d, dict) or list(d) != list(DIAGNOSIS_KEYS):
        return out | {"error": "diagnosis_keys"}
    if out["evidence_present"] is None or out["attributes"] is None or out["status"] not in STATUSES or out["reliability"] not in RELIABILITIES:
        return out | {"error": "types"}
    out["schema_ok"] = True
    box = out["region"]
    boxed = box is not None and len(box) == 4 and box[2] > box[0] and box[3] > box[1]
    if out["evidence_present"]:
        good = boxed and out["status"] == "supported" and out["pest_id"] is not None and out["reliability"] == "supported"
    else:
        good = region is None and out["status"] != "supported" and out["pest_id"] is None and out["reliability"] != "supported"
    return out | ({"semantic": True} if good else {"error": "semantics"})


def with_answers(df: DataFrame, text: str = "raw_text", tolerant: bool = False) -> DataFrame:
    """``df`` with the columns of SCHEMA parsed from ``text``; null texts are neither syntax nor schema.

    Columns of ``df`` of the same names are replaced.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kept = df.drop(*[n for n in names if n != text])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([parse_answer(t, tolerant) for t in pdf[text]], columns=names, index=pdf.index)
            found["pest_id"] = found["pest_id"].astype("Int32")
            yield pd.concat([pdf, found], axis=1)

    return kept.mapInPandas(run, f"{fields}, {SCHEMA}")


def compact_class_answer(raw: Column, allowed: tuple[str, ...] | None = None) -> Column:
    """The class of an answer that is exactly compact ``{"pest_id":"IPnnn"}``; null for anything else or outside ``allowed``."""
    found = F.regexp_extract(raw, r'^\{"pest_id":"(IP\d{3})"\}$', 1)
    return F.when((found != "") & (found.isin(*allowed) if allowed else F.lit(True)), found)


def render_answer(present: Column, region: Column, attributes: Column, diagnosis: Column, reliability: Column) -> Column:
    """The contract's JSON text with its fixed key order and explicit nulls."""
    value = F.struct(present.alias(KEYS[0]), region.alias(KEYS[1]), attributes.alias(KEYS[2]), diagnosis.alias(KEYS[3]), reliability.alias(KEYS[4]))
    return F.to_json(value, {"ignoreNullFields": "false"})


def flatten_json(text: str | None) -> list[str] | None:
    """Sorted ``a.b=value`` lines of a nested object; lists stay JSON. Null and malformed texts give null."""
    try:
        obj = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if not isinstance(obj, dict):
        return None

    def walk(prefix: str, v: object) -> Iterator[str]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(f"{prefix}.{k}" if prefix else k, x)
        else:
            yield f"{prefix}={v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(',', ':'))}"

    return sorted(walk("", obj))


def flattened(text: Column) -> Column:
    """``flatten_json`` of a column, in Arrow batches."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(flatten_json)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(text)
