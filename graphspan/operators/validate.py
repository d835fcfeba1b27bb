"""Constraint checks over nested graphs and sessions, and the canonical form.  Every check reports; none stops the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ASSERTIONS, CONCEPT_ID, MODALITIES, MOST_CHARS, MOST_NODES, MOST_RELATIONS, PROVENANCE_KINDS, ROLES, SCHEMA_VERSION, SHA256, TYPES


def _issue(bad: Column, path: Column | str, message: str) -> Column:
    """bad null counts as bad: a missing field can't satisfy a check."""
    return F.when(F.coalesce(bad, F.lit(True)), F.struct((path if isinstance(path, Column) else F.lit(path)).alias("path"), F.lit(message).alias("message")))


def _at(prefix: str, i: Column, field: str) -> Column:
    return F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit(f"].{field}"))


def _number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)


def _spans_bad(spans: Column, text: Column) -> Column:
    return F.exists(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,text:string>>")), lambda s: ~F.coalesce((s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)) & (F.substr(text, s["start"] + 1, s["end"] - s["start"]) == s["text"]), F.lit(False)))


def _refs_bad(refs: Column) -> Column:
    refs = F.coalesce(refs, F.array().cast("array<struct<id:string,conf:double,via:string>>"))
    ids = F.transform(refs, lambda r: r["id"])
    return (F.size(refs) > 8) | F.exists(refs, lambda r: ~F.coalesce((r["conf"] >= 0.5) & (r["conf"] <= 1) & r["id"].rlike(CONCEPT_ID), F.lit(False))) | (F.size(F.array_distinct(ids)) < F.size(ids))


def issues(graphs: DataFrame) -> DataFrame:
    """thought_id, path, message: all that is wrong with nested graphs (schema.GRAPH)."""
    text = F.col("source.text")
    node_ids = F.transform("nodes", lambda n: n["id"])
    rel_ids = F.transform("relations", lambda r: r["id"])
    extracted = F.col("provenance.kind") == "extracted"
    top = [
        _issue(F.col("schema_version") != SCHEMA_VERSION, "schema_version", "unsupported version"),
        _issue(~F.col("provenance.kind").isin(*PROVENANCE_KINDS), "provenance.kind", "unknown kind"),
        _issue(~F.col("source.sha256").rlike(SHA256), "source.sha256", "not a sha256"),
        _issue(F.sha2(text, 256) != F.col("source.sha256"), "source.sha256", "does not match text"),
        _issue(F.size("nodes") == 0, "nodes", "empty"),
        _issue(F.size(F.array_distinct(node_ids)) < F.size(node_ids), "nodes", "ids repeat"),
        _issue(F.size(F.array_distinct(rel_ids)) < F.size(rel_ids), "relations", "ids repeat"),
    ]

    def node(n: Column, i: Column) -> Column:
        at = lambda f: _at("nodes", i, f)
        return F.array(
            _issue(F.length(F.trim(n["label"])) == 0, at("label"), "empty"), _issue(~n["role"].isin(*ROLES), at("role"), "unknown role"), _issue(~_number(n["extract_conf"]), at("extract_conf"), "not between 0 and 1"),
            _issue(n["atomic"].isNull(), at("atomic"), "missing"), _issue(~F.coalesce(n["assertion"], F.lit("asserted")).isin(*ASSERTIONS), at("assertion"), "unknown assertion"),
            _issue(~F.coalesce(n["modality"], F.lit("actual")).isin(*MODALITIES), at("modality"), "unknown modality"), _issue(extracted & (F.coalesce(F.size(n["spans"]), F.lit(0)) < 1), at("spans"), "extracted without span"),
            _issue(_spans_bad(n["spans"], text), at("spans"), "not grounded in the source"), _issue(_refs_bad(n["knowledge"]["about"]) | _refs_bad(n["knowledge"]["requires"]), at("knowledge"), "bad references"),
        )

    def relation(r: Column, i: Column) -> Column:
        at = lambda f: _at("relations", i, f)
        return F.array(
            _issue(~F.array_contains(node_ids, r["source"]), at("source"), "unknown node"), _issue(~F.array_contains(node_ids, r["target"]), at("target"), "unknown node"), _issue(r["source"] == r["target"], at("target"), "same as source"),
            _issue(~r["type"].isin(*TYPES), at("type"), "unknown type"), _issue(~_number(r["extract_conf"]), at("extract_conf"), "not between 0 and 1"), _issue(~F.coalesce(r["assertion"], F.lit("asserted")).isin(*ASSERTIONS), at("assertion"), "unknown assertion"),
            _issue(~F.coalesce(r["modality"], F.lit("actual")).isin(*MODALITIES), at("modality"), "unknown modality"), _issue(_spans_bad(r["spans"], text), at("spans"), "not grounded in the source"),
        )

    every = F.concat(F.array(*top), F.flatten(F.transform("nodes", node)), F.flatten(F.transform("relations", relation)))
    return graphs.select("thought_id", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select("thought_id", "x.path", "x.message")


def orphans(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, rel, missing: ends of relations that no node of the graph has."""
    ends = relations.select("graph_id", "rel", F.explode(F.array("src", "dst")).alias("node"))
    return ends.join(nodes.select("graph_id", "node"), ["graph_id", "node"], "left_anti").select("graph_id", "rel", F.col("node").alias("missing"))


def repeated_ids(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def within_bounds(graphs: DataFrame) -> Column:
    """Limits of ingestion: text, nodes, relations."""
    return (F.length("source.text") <= MOST_CHARS) & (F.size("nodes") <= MOST_NODES) & (F.size("relations") <= MOST_RELATIONS)


def canonical(graphs: DataFrame) -> DataFrame:
    """thought_id, canonical, sha: JSON with defaults made plain, nodes, relations, spans and references in order.

    Fields are declared in alphabetical order, so equal graphs give equal text.
    """
    spans = lambda s: F.array_sort(F.coalesce(F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))), F.array().cast("array<struct<start:int,end:int,text:string>>")))
    refs = lambda r: F.array_sort(F.coalesce(F.transform(r, lambda x: F.struct(x["id"].alias("id"), x["conf"].alias("conf"), x["via"].alias("via"))), F.array().cast("array<struct<id:string,conf:double,via:string>>")))
    nodes = F.array_sort(F.transform("nodes", lambda n: F.struct(
        n["id"].alias("id"), F.coalesce(n["assertion"], F.lit("asserted")).alias("assertion"), n["atomic"].alias("atomic"), n["extract_conf"].alias("extract_conf"), F.struct(refs(n["knowledge"]["about"]).alias("about"), refs(n["knowledge"]["requires"]).alias("requires")).alias("knowledge"),
        n["label"].alias("label"), F.coalesce(n["modality"], F.lit("actual")).alias("modality"), n["role"].alias("role"), spans(n["spans"]).alias("spans"))))
    relations = F.array_sort(F.transform("relations", lambda r: F.struct(
        r["id"].alias("id"), F.coalesce(r["assertion"], F.lit("asserted")).alias("assertion"), r["extract_conf"].alias("extract_conf"), F.coalesce(r["modality"], F.lit("actual")).alias("modality"),
        F.array_sort(F.coalesce(r["provenance_refs"], F.array().cast("array<string>"))).alias("provenance_refs"), r["source"].alias("source"), spans(r["spans"]).alias("spans"), r["target"].alias("target"), r["type"].alias("type"))))
    text = F.to_json(F.struct(nodes.alias("nodes"), "provenance", relations.alias("relations"), "schema_version", "source", "thought_id"))
    return graphs.select("thought_id", text.alias("canonical"), F.sha2(text, 256).alias("sha"))


def helper_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts])), 256), 1, 20))


CONTACT = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+|https?://|\+?\d[\d\s().-]{7,}\d"


def session_issues(sessions: DataFrame) -> DataFrame:
    """session_id, issue: flat sessions (session_id, share_*, city, region, lat, lon, record_kind)."""
    checks = F.array(
        F.when(~F.col("session_id").cast("string").rlike(r"^(ses-)?[a-z0-9-]+$"), "id"), F.when(F.col("share_enabled").isNull() | F.col("share_thought").isNull(), "consent"),
        F.when(F.col("share_thought") & ~F.col("share_enabled"), "thought without sharing"), F.when((F.bround("lat", 1) != F.col("lat")) | (F.bround("lon", 1) != F.col("lon")), "precise location"),
        F.when((F.abs("lat") > 90) | (F.abs("lon") > 180), "location out of range"), F.when(F.concat_ws(" ", "city", "region").rlike(CONTACT), "contact data"), F.when(F.coalesce(F.col("record_kind"), F.lit("")) == "", "record kind"),
    )
    return sessions.select("session_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("issue"))


def corpus_checks(sessions: DataFrame, least: int = 20, most: int = 50, people: int = 8) -> DataFrame:
    """One row: rows, people, ids that repeat, and whether a demonstration corpus may have that."""
    facts = sessions.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("people"), (F.count("*") - F.count_distinct("session_id")).alias("repeated"))
    return facts.withColumn("valid", F.col("rows").between(least, most) & (F.col("people") >= people) & (F.col("repeated") == 0))


def control_fields(payload: DataFrame, reserved: tuple[str, ...] = ("thought_id", "session_id", "owner", "consent", "confirmation")) -> DataFrame:
    """id, fields: reserved keys that a JSON object brings along."""
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    return payload.select("id", F.array_intersect(keys, F.array(*[F.lit(r) for r in reserved])).alias("fields")).filter(F.size("fields") > 0)
