"""Whole-mapping evidence by joins: contradictions of projected ends, and how connected preserved relations are.

Pairs may be very many; everything is keyed by (query_id, graph_id) and a node or relation, and no list of a pair's relations is made.
Functions named ``..._of`` take pairs of graphs as rows, whose relations are short lists, and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import let

PAIR = ["query_id", "graph_id"]


def _ends(relations: DataFrame) -> DataFrame:
    """graph_id, rel, type, conf, at, other, dir: each relation seen from its source (out) and from its target (in)."""
    both = F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("other"), F.lit("out").alias("dir")), F.struct(F.col("dst").alias("at"), F.col("src").alias("other"), F.lit("in").alias("dir")))
    return relations.select("graph_id", "rel", "type", "conf", F.explode(both).alias("e")).select("graph_id", "rel", "type", "conf", "e.*")


def global_conflicts(mapping: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, graph_id, q_rel, c_rel, weight: both sides state a type in one direction at mapped nodes, but towards different
    mapped nodes.  mapping: query_id, graph_id, q, c (one to one).

    A side that states nothing there is unobserved evidence and contradicts nothing.  Of each query relation whose other end, once
    mapped, the candidate hasn't, the first candidate relation whose other end the query hasn't is the contradiction; a pair of
    relations counts once, from whichever end it is seen."""
    group = [*PAIR, "c", "type", "dir"]
    ends = _ends(relations)
    q = ends.withColumnRenamed("graph_id", "query_id").withColumnRenamed("at", "q").join(mapping, ["query_id", "q"])
    q = q.join(mapping.select(*PAIR, F.col("q").alias("other"), F.col("c").alias("to")), [*PAIR, "other"]).select(*group, "to", F.col("rel").alias("q_rel"), F.col("conf").alias("q_conf"))
    c = ends.withColumnRenamed("at", "c").join(mapping.select(*PAIR, "c"), ["graph_id", "c"])
    c = c.join(mapping.select(*PAIR, F.col("c").alias("other")), [*PAIR, "other"]).select(*group, F.col("other").alias("to"), F.col("rel").alias("c_rel"), F.col("conf").alias("c_conf"))
    only_q = q.join(c.select(*group, "to").distinct(), [*group, "to"], "left_anti")
    only_c = c.join(q.select(*group, "to").distinct(), [*group, "to"], "left_anti")
    first = only_c.groupBy(*group).agg(F.min(F.struct("c_rel", "c_conf")).alias("x"))
    met = only_q.join(first, group).select(*PAIR, "q_rel", F.col("x.c_rel").alias("c_rel"), F.least("q_conf", "x.c_conf").alias("weight"))
    return met.groupBy(*PAIR, "q_rel", "c_rel").agg(F.max("weight").alias("weight"))


def preserved(mapping: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, graph_id, rel, src, dst, weight: query relations that the candidate has between the mapped ends, alike in type,
    assertion and modality; equal ones are matched one to one in their order."""
    said = ["type", "assertion", "modality"]
    to = lambda a, b: mapping.select(*PAIR, F.col("q").alias(a), F.col("c").alias(b))
    order = lambda *key: F.row_number().over(Window.partitionBy(*PAIR, *key, *said).orderBy("rel"))
    q = relations.withColumnRenamed("graph_id", "query_id").join(to("src", "a"), ["query_id", "src"]).join(to("dst", "b"), [*PAIR, "dst"]).withColumn("nth", order("a", "b"))
    c = mapping.select(*PAIR, F.col("c").alias("a")).join(relations.withColumnRenamed("src", "a").withColumnRenamed("dst", "b"), ["graph_id", "a"]).join(mapping.select(*PAIR, F.col("c").alias("b")), [*PAIR, "b"]).withColumn("nth", order("a", "b"))
    met = q.join(c.select(*PAIR, "a", "b", *said, "nth", F.col("conf").alias("c_conf")), [*PAIR, "a", "b", *said, "nth"])
    return met.select(*PAIR, "rel", "src", "dst", F.least("conf", "c_conf").alias("weight"))


def told_of() -> tuple[Column, Column]:
    """Of pairs as rows (see preserved_of), the relations of both sides between mapped nodes, in their order: arrays of e (rel, src, dst,
    conf, key: its ends on the candidate's side, type, assertion, modality) and nth (how many before it have the same key)."""
    qs, cs = F.transform("ms", lambda m: m["q"]), F.transform("ms", lambda m: m["c"])
    fields = lambda e, a, b: F.struct(e["rel"].alias("rel"), e["src"].alias("src"), e["dst"].alias("dst"), e["conf"].alias("conf"), F.struct(a.alias("a"), b.alias("b"), e["type"].alias("type"), e["assertion"].alias("assertion"), e["modality"].alias("modality")).alias("key"))
    at = lambda n: F.get(cs, (F.array_position(qs, n) - 1).cast("int"))
    there = lambda ids, es: F.filter(es, lambda e: F.array_contains(ids, e["src"]) & F.array_contains(ids, e["dst"]))
    nth = lambda s: F.transform(s, lambda e, i: F.struct(e.alias("e"), F.size(F.filter(F.slice(s, F.lit(1), i), lambda y: y["key"] == e["key"])).alias("nth")))
    told = lambda es: let(F.sort_array(es), nth)
    q = told(F.transform(there(qs, F.col("q_es")), lambda e: fields(e, at(e["src"]), at(e["dst"]))))
    c = told(F.transform(there(cs, F.col("c_es")), lambda e: fields(e, e["src"], e["dst"])))
    return q, c


def alike(x: Column, y: Column) -> Column:
    """Whether relations of both sides (told_of) are equal and so matched."""
    key = x["e"]["key"]
    return (y["e"]["key"] == key) & (y["nth"] == x["nth"]) & key["type"].isNotNull() & key["assertion"].isNotNull() & key["modality"].isNotNull()


def preserved_of(rows: DataFrame) -> DataFrame:
    """query_id, graph_id, rels (array of rel, src, dst, weight): the same of pairs as rows, with ms (array of q, c), q_es and c_es
    (features.pack).  A pair's relations are short lists."""
    q, c = told_of()
    met = lambda x, c: F.filter(c, lambda y: alike(x, y))
    found = lambda q, c: F.flatten(F.transform(q, lambda x: F.transform(met(x, c), lambda y: F.struct(x["e"]["rel"].alias("rel"), x["e"]["src"].alias("src"), x["e"]["dst"].alias("dst"), F.least(x["e"]["conf"], y["e"]["conf"]).alias("weight")))))
    return rows.select(*PAIR, let(q, lambda q: let(c, lambda c: found(q, c))).alias("rels"))


def global_conflicts_of(rows: DataFrame) -> DataFrame:
    """query_id, graph_id, found (array of q_rel, c_rel, weight): the same as global_conflicts, of pairs as rows (see preserved_of)."""
    qs, cs = F.transform("ms", lambda m: m["q"]), F.transform("ms", lambda m: m["c"])
    at = lambda n: F.get(cs, (F.array_position(qs, n) - 1).cast("int"))
    view = lambda e, node, to, dir_: F.struct(F.struct(node.alias("node"), e["type"].alias("type"), F.lit(dir_).alias("dir")).alias("group"), to.alias("to"), e["rel"].alias("rel"), e["conf"].alias("conf"))

    def seen(ids: Column, es: str, place: Callable[[Column], Column]) -> Column:
        there = F.filter(es, lambda e: F.array_contains(ids, e["src"]) & F.array_contains(ids, e["dst"]) & e["type"].isNotNull())
        return F.flatten(F.transform(there, lambda e: F.array(view(e, place(e["src"]), place(e["dst"]), "out"), view(e, place(e["dst"]), place(e["src"]), "in"))))

    only = lambda xs, ys: F.filter(xs, lambda x: ~F.exists(ys, lambda y: (y["group"] == x["group"]) & (y["to"] == x["to"])))
    first = lambda x, ys: F.array_min(F.transform(F.filter(ys, lambda y: y["group"] == x["group"]), lambda y: F.struct(y["rel"].alias("rel"), y["conf"].alias("conf"))))

    def met(xs: Column, ys: Column) -> Column:
        pairs = F.filter(F.transform(xs, lambda x: F.struct(x["rel"].alias("rel"), x["conf"].alias("conf"), first(x, ys).alias("c"))), lambda p: p["c"].isNotNull())
        return F.array_distinct(F.transform(pairs, lambda p: F.struct(p["rel"].alias("q_rel"), p["c"]["rel"].alias("c_rel"), F.least(p["conf"], p["c"]["conf"]).alias("weight"))))

    told = lambda q, c: let(only(q, c), lambda xs: let(only(c, q), lambda ys: met(xs, ys)))
    return rows.select(*PAIR, let(seen(qs, "q_es", at), lambda q: let(seen(cs, "c_es", lambda n: n), lambda c: told(q, c))).alias("found"))


def systematicity_of(kept_relations: DataFrame) -> DataFrame:
    """The same as systematicity, of preserved relations as rows (preserved_of)."""
    touches = lambda x, y: F.arrays_overlap(F.array(x["src"], x["dst"]), F.array(y["src"], y["dst"]))
    linked = F.transform("rels", lambda x: F.struct(x["weight"].alias("weight"), (F.size(F.filter("rels", lambda y: touches(x, y))) > 1).alias("linked")))
    rows = kept_relations.filter(F.size("rels") > 0).select(*PAIR, linked.alias("rels"))
    total = lambda weight: F.aggregate("rels", F.lit(0.0), lambda s, x: s + weight(x))
    mass = total(lambda x: x["weight"])
    share = total(lambda x: F.when(x["linked"], x["weight"]).otherwise(0.5 * x["weight"])) / mass
    return rows.select(*PAIR, F.size("rels").cast("long").alias("n"), F.size(F.filter("rels", lambda x: x["linked"])).cast("long").alias("connected"), F.when(mass > 0, share).otherwise(0.0).alias("systematicity"))


def systematicity(kept_relations: DataFrame) -> DataFrame:
    """query_id, graph_id, n, connected, systematicity of preserved relations (see above): those that share a node with another
    one count whole, others half.

    A relation is in a system of two or more exactly if one of its ends has another preserved relation, so no system has to be
    followed to its end."""
    rows = kept_relations.withColumn("ends", F.array_distinct(F.array("src", "dst")))
    busy = rows.select(*PAIR, F.explode("ends").alias("node")).groupBy(*PAIR, "node").agg(F.count("*").alias("degree")).filter("degree > 1").select(*PAIR, "node")
    linked = rows.select(*PAIR, "rel", F.explode("ends").alias("node")).join(busy, [*PAIR, "node"]).select(*PAIR, "rel").distinct().withColumn("linked", F.lit(True))
    told = rows.join(linked, [*PAIR, "rel"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    share: Column = F.sum(F.when(F.col("linked"), F.col("weight")).otherwise(0.5 * F.col("weight"))) / F.sum("weight")
    return told.groupBy(*PAIR).agg(F.count("*").alias("n"), F.count(F.when(F.col("linked"), 1)).alias("connected"), F.coalesce(share, F.lit(0.0)).alias("systematicity"))
