"""Similarity of labels: given pairs compared on what each distinct label has, and a join that finds like labels by themselves.

``features`` gives each distinct label its stems, its trigrams and its classes once.  ``compare`` holds given pairs against each
other.  ``twins`` finds all pairs whose surface reaches a threshold without looking at all pairs: a label is looked up by its
rarest stems and trigrams alone, as many as two labels of that likeness must share one of, and labels that meet are told apart by
short sketches before anything is written of them.  ``best_twin`` keeps the best of them for each label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..functions.stem import stem_phrase
from ..sources.scratch import kept, lookup_join

#: Of an encoder's relatedness, from which on two labels count as the same words.
SAME_WORDS = 0.6
#: What rounding may hide.
SLACK = 1e-9


def features(labels: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """label, stems (a set), grams (array of item, n), norm, abstract, domain of distinct labels; concepts: label, concepts."""
    rows = stem_phrase(labels.select("label").filter("label is not null").distinct(), "label")
    rows = rows.withColumn("stems", F.array_sort(F.array_distinct("stems"))).withColumn("grams", text.counts(text.trigrams(F.col("label"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("grams", F.lit(0.0), lambda s, g: s + g["n"] * g["n"])))
    if concepts is None:
        none = F.array().cast("array<string>")
        return rows.withColumns({"abstract": none, "domain": none})
    known = F.coalesce("concepts", F.array().cast("array<string>"))
    return rows.join(concepts, "label", "left").select("label", "stems", "grams", "norm", lexicon.abstract(known).alias("abstract"), lexicon.domains(known).alias("domain"))


def _surface(pairs: DataFrame) -> DataFrame:
    """Pairs of labels with both sides' features (stems_a, grams_a, ...) and lexical, trigram and surface similarity."""
    dot = F.aggregate("grams_a", F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.get(F.filter("grams_b", lambda y: y["item"] == x["item"]), F.lit(0))["n"], F.lit(0.0)))
    both = F.col("norm_a") * F.col("norm_b")
    rows = pairs.withColumns({"lexical": text.jaccard(F.col("stems_a"), F.col("stems_b")), "trigram": F.when(both == 0, 0.0).otherwise(dot / both)})
    return rows.withColumn("surface", text.surface(F.col("lexical"), F.col("trigram")))


def _sides(pairs: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("a", "b"):
        pairs = lookup_join(pairs, known.select(F.col("label").alias(f"label_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns]), [f"label_{side}"])
    return pairs


def compare(pairs: DataFrame, known: DataFrame, encoder: DataFrame | None = None) -> DataFrame:
    """label_a, label_b, lexical, trigram, surface, concept, domain, fused of distinct pairs (label_a, label_b).

    encoder: label_a, label_b, relatedness; it raises the concept, from SAME_WORDS on the surface too, and lowers nothing."""
    rows = _surface(_sides(pairs.select("label_a", "label_b").distinct(), known, ["stems", "grams", "norm", "abstract", "domain"]))
    rows = rows.withColumns({"concept": lexicon.soft_overlap_of(F.col("abstract_a"), F.col("abstract_b")), "domain": text.jaccard(F.col("domain_a"), F.col("domain_b"))})
    if encoder is not None:
        rows = rows.join(encoder.select("label_a", "label_b", "relatedness"), ["label_a", "label_b"], "left")
        told = F.coalesce("relatedness", F.lit(0.0))
        rows = rows.withColumns({"concept": F.greatest("concept", told), "surface": F.when(told >= SAME_WORDS, F.greatest("surface", told)).otherwise(F.col("surface"))})
    return rows.select("label_a", "label_b", "lexical", "trigram", "surface", "concept", "domain", text.fuse(F.col("surface"), F.col("concept"), F.col("domain")).alias("fused"))


def encoder_relatedness(pairs: DataFrame, vectors: DataFrame, scale: float = 1.0) -> DataFrame:
    """label_a, label_b, relatedness of the pairs needed, by an encoder's vectors (label, v): rescaled cosines, above 0 alone."""
    norm = F.sqrt(text.dot(F.col("v"), F.col("v")))
    unit = vectors.select("label", F.when(norm > 0, F.transform("v", lambda x: x.cast("double") / norm)).alias("v")).filter("v is not null")
    rows = _sides(pairs.select("label_a", "label_b").distinct(), kept(unit), ["v"])
    cosine = text.dot(F.col("v_a"), F.col("v_b"))
    return rows.select("label_a", "label_b", text.rescale(scale * F.abs(cosine) if scale != 1.0 else cosine).alias("relatedness")).filter("relatedness > 0")


def _sketched(known: DataFrame) -> DataFrame:
    """known with stem_bits and gram_bits: every stem, and every occurrence of a trigram, turns one of 128 bits over, so two labels'
    bits differ in no more places than their sets or counts do."""

    def bits(items: Column) -> Column:
        place = F.transform(items, lambda x: F.pmod(F.xxhash64(x), F.lit(128)).cast("int"))
        half = lambda low: F.aggregate(place, F.lit(0).cast("long"), lambda s, p: F.when((p >= low) & (p < low + 64), s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p - low))).otherwise(s))
        return F.struct(half(0).alias("low"), half(64).alias("high"))

    each = F.flatten(F.transform("grams", lambda g: F.transform(F.sequence(F.lit(1), g["n"].cast("int")), lambda i: F.struct(g["item"].alias("item"), i.alias("i")))))
    return known.withColumns({"stem_bits": bits(F.col("stems")), "gram_bits": bits(each)})


def _prefix(known: DataFrame, kind: str, least: float) -> DataFrame:
    """label, item, size, bits: the items that a label is looked up by, the rarest first.  Stems: two sets of a Jaccard of ``least``
    share one of the first n - ceil(least * n) + 1.  Trigrams: the items up to which what is left has a norm of ``least`` times
    the whole, so that without a common one among them no cosine of that size is left."""
    if kind == "stems":
        items = known.select("label", F.size("stems").cast("double").alias("size"), F.col("stem_bits").alias("bits"), F.explode("stems").alias("item")).withColumn("n", F.lit(1.0))
    else:
        items = known.select("label", F.col("norm").alias("size"), F.col("gram_bits").alias("bits"), F.explode("grams").alias("g")).select("label", "size", "bits", "g.item", "g.n")
    counted = lookup_join(items, kept(items.groupBy("item").agg(F.count("*").alias("df"))), ["item"])
    rare = Window.partitionBy("label").orderBy("df", "item")
    if kind == "stems":
        ranked = counted.withColumn("place", F.row_number().over(rare))
        return ranked.filter(F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - SLACK) + 1).select("label", "item", "size", "bits")
    before = F.coalesce(F.sum(F.col("n") * F.col("n")).over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return counted.withColumn("rest", F.sqrt(F.greatest(F.lit(0.0), F.col("size") * F.col("size") - before))).filter(F.col("rest") >= (least - SLACK) * F.col("size")).select("label", "item", "size", "bits")


def _met(rows: DataFrame, differ: Column) -> DataFrame:
    """label_a, label_b of rows (label, item, size, bits) that share an item and whose bits differ in at most ``differ`` (of size_a,
    size_b) places.  Pairs are judged where they meet; those that can't be alike are never shuffled or written."""
    a, b = (rows.select(F.col("label").alias(f"label_{s}"), "item", F.col("size").alias(f"size_{s}"), F.col("bits.low").alias(f"low_{s}"), F.col("bits.high").alias(f"high_{s}")) for s in "ab")
    apart = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b")))
    return a.join(b.hint("merge"), "item").filter((apart <= differ + 1e-6) & (F.col("label_a") < F.col("label_b"))).select("label_a", "label_b").distinct()


def twins(known: DataFrame, least: float = 0.8) -> DataFrame:
    """label_a, label_b, surface: all ordered pairs of different labels whose surface is at least ``least`` (above 0.425).

    Two sets of a Jaccard of t differ in (1 - t) / (1 + t) of their sizes at most; counts of norms A and B with a cosine of t in
    A^2 + B^2 - 2 t A B at most, as whole numbers are no greater than their squares."""
    if least <= 0.425:
        raise ValueError("trigrams say too little up to a surface of 0.425")
    known = kept(_sketched(known))
    x, y = F.col("size_a"), F.col("size_b")
    met = _met(kept(_prefix(known, "stems", least)), (x + y) * ((1 - least) / (1 + least)))
    if least <= 0.85:
        met = met.unionByName(_met(kept(_prefix(known, "grams", least / 0.85)), x * x + y * y - 2 * (least / 0.85) * x * y)).distinct()
    found = _surface(_sides(kept(met), known, ["stems", "grams", "norm"])).filter(F.col("surface") >= least - SLACK).select("label_a", "label_b", "surface")
    found = kept(found)
    return found.unionByName(found.select(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"), "surface"))


def best_twin(pairs: DataFrame) -> DataFrame:
    """label, twin, surface: the likest other label, of equal ones the first."""
    w = Window.partitionBy("label_a").orderBy(F.round(F.col("surface"), 9).desc(), "label_b")
    return pairs.withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.col("label_a").alias("label"), F.col("label_b").alias("twin"), "surface")


def node_affinity(pairs: DataFrame, nodes: DataFrame, knowledge: DataFrame, compared: DataFrame, role_fit: Column, weights: dict[str, float]) -> DataFrame:
    """query_id, graph_id, q, c, affinity of every node of a pair's query with every node of its candidate: role, label (fused)
    and knowledge (Jaccard of what the nodes refer to), times the lower confidence.  role_fit: of columns role and role_c."""
    refs = knowledge.groupBy("graph_id", "node").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    full = nodes.join(refs, ["graph_id", "node"], "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    q = full.select(F.col("graph_id").alias("query_id"), F.col("node").alias("q"), F.col("label").alias("label_a"), "role", "conf", "refs")
    c = full.select("graph_id", F.col("node").alias("c"), F.col("label").alias("label_b"), F.col("role").alias("role_c"), F.col("conf").alias("conf_c"), F.col("refs").alias("refs_c"))
    return _affinity(pairs.select("query_id", "graph_id").join(q, "query_id").join(c, "graph_id"), compared, role_fit, weights)


def node_affinity_of(pairs: DataFrame, compared: DataFrame, role_fit: Column, weights: dict[str, float]) -> DataFrame:
    """The same of pairs as rows: query_id, graph_id, q_ns and c_ns (arrays of node, label, role, conf, refs)."""
    rows = pairs.select("query_id", "graph_id", F.explode("q_ns").alias("x"), "c_ns").select("query_id", "graph_id", "x", F.explode("c_ns").alias("y"))
    mine, theirs = {"node": "q", "label": "label_a"}, {"node": "c", "label": "label_b", "role": "role_c", "conf": "conf_c", "refs": "refs_c"}
    field = lambda side, names: [F.col(f"{side}.{f}").alias(names.get(f, f)) for f in ("node", "label", "role", "conf", "refs")]
    return _affinity(rows.select("query_id", "graph_id", *field("x", mine), *field("y", theirs)), compared, role_fit, weights)


def _affinity(rows: DataFrame, compared: DataFrame, role_fit: Column, weights: dict[str, float]) -> DataFrame:
    rows = lookup_join(rows, compared.select("label_a", "label_b", "fused"), ["label_a", "label_b"])
    value = F.least("conf", "conf_c") * (weights["role"] * role_fit + weights["label"] * F.col("fused") + weights["knowledge"] * text.jaccard(F.col("refs"), F.col("refs_c")))
    return rows.select("query_id", "graph_id", "q", "c", value.alias("affinity"))


def label_conflicts(mapping: DataFrame, nodes: DataFrame, compared: DataFrame, twin: float, chosen: float) -> DataFrame:
    """query_id, graph_id, q, c, weight: pairs of nodes that the words say belong together and a mapping (query_id, graph_id, q, c)
    doesn't pair: where a mapped pair's labels have a fused similarity below ``chosen``, the best twin of either node on the other
    side, with a surface of at least ``twin``; the first of equals.  compared: fused and surface of label pairs."""
    side = lambda name, node, label: nodes.select(F.col("graph_id").alias(name), F.col("node").alias(node), F.col("label").alias(label), F.col("conf").alias(f"conf_{node}"))
    query, cand = side("query_id", "q", "label_a"), side("graph_id", "c", "label_b")
    fits = compared.select("label_a", "label_b", "fused")
    weak = lookup_join(mapping.join(query, ["query_id", "q"]).join(cand, ["graph_id", "c"]), fits, ["label_a", "label_b"]).filter(F.col("fused") < chosen)
    weak = kept(weak.select("query_id", "graph_id", "q", "c", "label_a", "label_b", "conf_q", "conf_c"))
    like = kept(compared.filter(F.col("surface") >= twin).select("label_a", "label_b", "surface"))

    def best(mine: str, other: str, others: DataFrame, where: str) -> DataFrame:
        key = f"label_{'a' if mine == 'q' else 'b'}"
        found = lookup_join(weak.select("query_id", "graph_id", "q", "c", key, f"conf_{mine}"), like, [key])
        found = found.join(others.select(where, F.col(other).alias("twin"), others.columns[2], F.col(f"conf_{other}").alias("conf_twin")), [where, others.columns[2]]).filter(F.col("twin") != F.col(other))
        w = Window.partitionBy("query_id", "graph_id", "q", "c").orderBy(F.desc("surface"), "twin")
        first = found.withColumn("k", F.row_number().over(w)).filter("k = 1")
        return first.select("query_id", "graph_id", F.col(mine).alias(mine), F.col("twin").alias(other), (F.least(f"conf_{mine}", "conf_twin") * F.col("surface")).alias("weight"))

    found = best("q", "c", cand, "graph_id").unionByName(best("c", "q", query, "query_id"))
    return found.groupBy("query_id", "graph_id", "q", "c").agg(F.max("weight").alias("weight"))



def label_conflicts_of(pairs: DataFrame, compared: DataFrame, twin: float, chosen: float) -> DataFrame:
    """The same of pairs as rows: query_id, graph_id, ms (array of q, c), q_ns and c_ns (arrays of node, label, conf)."""
    both = ["query_id", "graph_id"]
    node = lambda ns, n: F.get(F.filter(ns, lambda x: x["node"] == n), F.lit(0))
    rows = pairs.select(*both, "q_ns", "c_ns", F.explode("ms").alias("m")).select(*both, "q_ns", "c_ns", node("q_ns", F.col("m.q")).alias("x"), node("c_ns", F.col("m.c")).alias("y"))
    rows = rows.withColumns({"label_a": F.col("x.label"), "label_b": F.col("y.label")})
    weak = lookup_join(rows, compared.select("label_a", "label_b", "fused"), ["label_a", "label_b"]).filter(F.col("fused") < chosen)
    like = kept(compared.filter(F.col("surface") >= twin).select("label_a", "label_b", "surface"))
    for mine, other in (("label_a", "label_b"), ("label_b", "label_a")):
        listed = kept(like.groupBy(mine).agg(F.collect_list(F.struct(F.col(other).alias("label"), "surface")).alias(f"like_{mine}")))
        weak = lookup_join(weak, listed, [mine], "left")

    def best(key: str, others: str, held: str) -> Column:
        of = lambda z: F.transform(F.filter(key, lambda l: l["label"] == z["label"]), lambda l: F.struct((-l["surface"]).alias("rank"), z["node"].alias("node"), z["conf"].alias("conf")))
        return F.array_min(F.flatten(F.transform(F.filter(others, lambda z: z["node"] != F.col(held)), of)))

    weak = weak.select(*both, "x", "y", best("like_label_a", "c_ns", "y.node").alias("of_x"), best("like_label_b", "q_ns", "x.node").alias("of_y"))
    told = lambda q, c, mine, found: F.when(F.col(found).isNotNull(), F.struct(F.col(q).alias("q"), F.col(c).alias("c"), (F.least(mine, f"{found}.conf") * -F.col(f"{found}.rank")).alias("weight")))
    each = weak.select(*both, F.explode(F.array(told("x.node", "of_x.node", "x.conf", "of_x"), told("of_y.node", "y.node", "y.conf", "of_y"))).alias("e")).filter("e is not null")
    return each.groupBy(*both, "e.q", "e.c").agg(F.max("e.weight").alias("weight"))
