"""Authored graphs for checks that derived tables can't exercise."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..schema import GRAPH, SCHEMA_VERSION

TEXT = "Rising heat causes pump wear. Cooling prevents heat."


def _span(text: str, part: str) -> dict:
    at = text.index(part)
    return {"start": at, "end": at + len(part), "text": part}


def record(thought_id: str, **change) -> dict:
    """A valid extracted graph, with changes to its top fields."""
    node = lambda i, label, role: {"id": i, "label": label, "role": role, "spans": [_span(TEXT, label)], "extract_conf": 0.9, "atomic": True, "assertion": "asserted", "modality": "actual", "knowledge": None}
    relation = lambda i, a, b, kind: {"id": i, "source": a, "target": b, "type": kind, "extract_conf": 0.9, "spans": [_span(TEXT, kind)], "cue": _span(TEXT, kind), "assertion": "asserted", "modality": "actual", "provenance_refs": []}
    out = {
        "thought_id": thought_id, "schema_version": SCHEMA_VERSION, "source": {"text": TEXT, "sha256": hashlib.sha256(TEXT.encode()).hexdigest()}, "provenance": {"kind": "extracted", "extractor": {"id": "cue", "version": "1"}, "human_id": None},
        "nodes": [node("n1", "Rising heat", "state"), node("n2", "pump wear", "outcome"), node("n3", "Cooling", "method")], "relations": [relation("r1", "n1", "n2", "causes"), relation("r2", "n3", "n1", "prevents")],
    }
    return out | change


def records() -> list[dict]:
    good = record("good")
    bad_role = record("bad-role", nodes=[n | {"role": "weather"} if n["id"] == "n2" else n for n in good["nodes"]])
    moved = record("moved-span", nodes=[n | {"spans": [{"start": 3, "end": 8, "text": "wrong"}]} if n["id"] == "n1" else n for n in good["nodes"]])
    dangling = record("dangling", relations=[r | {"target": "n9"} if r["id"] == "r1" else r for r in good["relations"]])
    return [good, record("shuffled", nodes=good["nodes"][::-1]), bad_role, moved, dangling, record("bad-sha", source={"text": TEXT, "sha256": "0" * 64}), record("manual", provenance={"kind": "guess", "extractor": None, "human_id": "h"})]


def graphs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(records(), GRAPH)
