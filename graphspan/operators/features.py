"""Features of typed graphs: adjacency, descriptors, canonical paths, fingerprints, colourings and the census of shapes.

Inputs are exploded tables: nodes (graph_id, node, role, ...) and relations (graph_id, rel, src, dst, type, assertion, ...).
Everything is keyed by graph_id, so one partitioning serves every step.

Functions named ``..._of`` take graphs as rows (``pack``): a graph's nodes and relations are bounded lists, and what concerns one
graph alone is worked out inside its row, without any further shuffle or table between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Parts the tokens of a path; sorts below every character of a token, so strings compare as sequences do.
STEP = "\u0001"


def sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pack(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, ns (array of node, role, ... in order of node), es (array of rel, src, dst, type, assertion, ...): a row for each
    graph that has nodes."""
    first = [c for c in ("node", "role") if c in nodes.columns]
    dots = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(*first, *[c for c in nodes.columns if c not in ("graph_id", *first)]))).alias("ns"))
    ends = relations.groupBy("graph_id").agg(F.collect_list(F.struct(*[c for c in relations.columns if c != "graph_id"])).alias("es"))
    none = F.array().cast(ends.schema["es"].dataType)
    return dots.join(ends, "graph_id", "left").select("graph_id", "ns", F.coalesce("es", none).alias("es"))


def _place(ids: Column, node: Column) -> Column:
    return (F.array_position(ids, node) - 1).cast("int")


def _views(ids: Column, es: Column) -> Column:
    """Array of a, b, dir, type, assertion: relations seen from both ends, if the other end is there."""
    both = F.flatten(F.transform(es, lambda e: F.array(
        F.struct(e["src"].alias("a"), e["dst"].alias("b"), F.lit("+").alias("dir"), e["type"].alias("type"), e["assertion"].alias("assertion")),
        F.struct(e["dst"].alias("a"), e["src"].alias("b"), F.lit("-").alias("dir"), e["type"].alias("type"), e["assertion"].alias("assertion")),
    )))
    return F.filter(both, lambda v: F.array_contains(ids, v["b"]))


def _ids() -> Column:
    return F.transform("ns", lambda n: n["node"])


def adjacency(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, a, b, dir, type, assertion, role_b: every relation seen from both of its ends."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("+").alias("dir")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("-").alias("dir"))))
    both = relations.select("graph_id", "type", "assertion", ends.alias("e")).select("graph_id", "e.a", "e.b", "e.dir", "type", "assertion")
    return both.join(nodes.select("graph_id", F.col("node").alias("b"), F.col("role").alias("role_b")), ["graph_id", "b"]).select("graph_id", "a", "b", "dir", "type", "assertion", "role_b")


def d0(nodes: DataFrame) -> DataFrame:
    return nodes.select("graph_id", "node", F.col("role").alias("descriptor"))


def d1(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """One round of colouring: a node's role with the sorted views of its neighbours."""
    around = adj.groupBy("graph_id", F.col("a").alias("node")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "dir", "type", "assertion", "role_b"))), ",").alias("around"))
    return nodes.join(around, ["graph_id", "node"], "left").select("graph_id", "node", sha("role", F.coalesce("around", F.lit(""))).alias("descriptor"))


def _coloured(ids: Column, views: Column) -> Column:
    """D1 descriptors of a graph's nodes in their order."""
    role = lambda b: F.get("ns", _place(ids, b))["role"]
    seen = lambda n: F.transform(F.filter(views, lambda v: v["a"] == n["node"]), lambda v: F.concat_ws("/", v["dir"], v["type"], v["assertion"], role(v["b"])))
    return F.transform("ns", lambda n: sha(n["role"], F.array_join(F.sort_array(seen(n)), ",")))


def d1_of(graphs: DataFrame) -> DataFrame:
    """The same descriptors as d1."""
    known = let(_ids(), lambda ids: let(_views(ids, F.col("es")), lambda views: _coloured(ids, views)))
    rows = graphs.select("graph_id", F.explode(F.arrays_zip(_ids().alias("node"), known.alias("descriptor"))).alias("x"))
    return rows.select("graph_id", F.col("x.node").alias("node"), F.col("x.descriptor").alias("descriptor"))


def _way(a: Column, b: Column, path: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), path.isNull().alias("none"), path.alias("path"))


def _least(ways: Column) -> Column:
    """The least way of each ordered pair."""
    other = lambda x, y: (x["a"] != y["a"]) | (x["b"] != y["b"])
    return let(F.sort_array(ways), lambda s: F.filter(s, lambda x, i: (i == 0) | other(x, F.get(s, F.greatest(i - 1, F.lit(0))))))


def _walked(views: Column, longest: int) -> Column:
    """Array of a, b, hops, path (see paths) of one graph."""
    numbered = lambda ways, hops: F.transform(ways, lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), F.lit(hops).alias("hops"), w["path"].alias("path")))

    def onward(step: Column, last: Column, known: Column, hops: int) -> Column:
        on = lambda x: F.filter(step, lambda y: (y["a"] == x["b"]) & (y["b"] != x["a"]) & ~F.exists(known, lambda f: (f["a"] == x["a"]) & (f["b"] == y["b"])))
        grown = F.flatten(F.transform(last, lambda x: F.transform(on(x), lambda y: _way(x["a"], y["b"], F.concat(x["path"], F.lit(STEP), y["path"])))))
        return let(_least(grown), lambda new: numbered(new, hops) if hops == longest else F.concat(numbered(new, hops), onward(step, new, F.concat(known, new), hops + 1)))

    first = _least(F.transform(views, lambda v: _way(v["a"], v["b"], F.concat(v["dir"], v["type"], F.lit("/"), v["assertion"]))))
    return let(first, lambda step: numbered(step, 1) if longest == 1 else F.concat(numbered(step, 1), onward(step, step, step, 2)))


def paths_of(graphs: DataFrame, longest: int = 3) -> DataFrame:
    """graph_id, a, b, hops, path: for each ordered pair the shortest way and of these the least sequence of tokens.

    Pairs already reached are dropped after each hop, so hubs don't multiply."""
    found = let(_ids(), lambda ids: let(_views(ids, F.col("es")), lambda views: _walked(views, longest)))
    return graphs.select("graph_id", F.explode(found).alias("x")).select("graph_id", "x.a", "x.b", "x.hops", "x.path")


def paths(adj: DataFrame, longest: int = 3) -> DataFrame:
    """The same from views of relations: graph_id, a, b, dir, type, assertion."""
    rows = adj.groupBy("graph_id").agg(F.collect_list(F.struct("a", "b", "dir", "type", "assertion")).alias("views"))
    return rows.select("graph_id", F.explode(_walked(F.col("views"), longest)).alias("x")).select("graph_id", "x.a", "x.b", "x.hops", "x.path")


def fingerprints(found: DataFrame, descriptors: DataFrame, scale: str) -> DataFrame:
    """graph_id, key, a, b: a key for each ordered pair of landmarks on a path, from both descriptors and the path."""
    at = lambda end: descriptors.select("graph_id", F.col("node").alias(end), F.col("descriptor").alias(f"d_{end}"))
    return found.join(at("a"), ["graph_id", "a"]).join(at("b"), ["graph_id", "b"]).select("graph_id", sha(F.lit(scale), "d_a", "path", "d_b").alias("key"), "a", "b")


def _printed(longest: int, scales: tuple[str, ...]) -> Column:
    """Array of key, a, b of one graph."""

    def keys(ids: Column, views: Column, colours: Column) -> Column:
        told = lambda scale, i: F.get("ns", i)["role"] if scale == "D0" else F.get(colours, i)
        key = lambda scale, x: F.struct(sha(F.lit(scale), told(scale, _place(ids, x["a"])), x["path"], told(scale, _place(ids, x["b"]))).alias("key"), x["a"].alias("a"), x["b"].alias("b"))
        ends = F.filter(_walked(views, longest), lambda x: F.array_contains(ids, x["a"]))
        return F.flatten(F.transform(ends, lambda x: F.array(*[key(scale, x) for scale in scales])))

    colours = lambda ids, views: _coloured(ids, views) if "D1" in scales else F.array().cast("array<string>")
    return let(_ids(), lambda ids: let(_views(ids, F.col("es")), lambda views: let(colours(ids, views), lambda c: keys(ids, views, c))))


def fingerprints_of(graphs: DataFrame, longest: int = 3, scales: tuple[str, ...] = ("D0", "D1")) -> DataFrame:
    """graph_id, key, a, b: the same keys of each scale."""
    return graphs.select("graph_id", F.explode(_printed(longest, scales)).alias("x")).select("graph_id", "x.key", "x.a", "x.b")


def keysets_of(graphs: DataFrame, size: int = 32) -> DataFrame:
    """graph_id, key: a graph's different keys, told apart in its row, so nothing is shuffled; of each digest the first so many bytes (a
    key of hex digits takes twice as many; 16 bytes are enough to tell keys apart)."""
    keys = F.array_distinct(F.transform(_printed(3, ("D0", "D1")), lambda x: x["key"]))
    return graphs.select("graph_id", F.explode(keys).alias("key")).select("graph_id", F.unhex(F.substring("key", 1, 2 * size)).alias("key"))


def multi_fingerprints(nodes: DataFrame, relations: DataFrame, longest: int = 3) -> DataFrame:
    """Both scales, D0 and D1."""
    return fingerprints_of(pack(nodes.select("graph_id", "node", "role"), relations.select("graph_id", "src", "dst", "type", "assertion")), longest)


def keysets(prints: DataFrame) -> DataFrame:
    return prints.select("graph_id", "key").distinct()


def shape_signatures(nodes: DataFrame, relations: DataFrame, rounds: int | None = None) -> DataFrame:
    """graph_id, signature, n_nodes, n_relations: equal for isomorphic shapes, labels aside.

    A graph is one row, its nodes' colours an array that is refined inside one expression: as many rounds as it has nodes at
    most, and none after the first that tells no more nodes apart.  By then each colour of a graph stands for one of the round
    before, so further rounds couldn't tell two graphs of equal colours apart either.
    """
    said = [c for c in ("assertion", "modality") if c in nodes.columns]
    return shapes_of(pack(nodes.select("graph_id", "node", "role", *said), relations), rounds, *said)


def shapes_of(graphs: DataFrame, rounds: int | None = None, *said: str) -> DataFrame:
    """The same of graphs as rows; said: what of their nodes colours them beside the role."""
    ends = F.transform("es", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.concat_ws("/", e["type"], e["assertion"], e["modality"]).alias("kind")))
    rows = graphs.select("graph_id", ends.alias("es"), _ids().alias("ids"), F.transform("ns", lambda n: sha(n["role"], *[n[c] for c in said])).alias("start"))
    known = F.filter("es", lambda e: F.array_contains("ids", e["src"]) & F.array_contains("ids", e["dst"]))
    rows = rows.select("graph_id", "ids", "start", F.size("es").alias("n_relations"), known.alias("es"))

    def seen(here: str, there: str, mark: str, node: Column) -> Column:
        mine = F.filter("es", lambda e: e[here] == node)
        return F.transform(mine, lambda e: F.struct(F.concat(F.lit(mark + "/"), e["kind"], F.lit("/")).alias("tag"), (F.array_position("ids", e[there]) - 1).cast("int").alias("other")))

    rows = rows.withColumn("views", F.transform("ids", lambda i: F.concat(seen("src", "dst", "+", i), seen("dst", "src", "-", i))))

    def refined(colours: Column) -> Column:
        around = lambda view: F.array_join(F.array_sort(F.transform(view, lambda x: F.concat(x["tag"], F.get(colours, x["other"])))), ",")
        return F.transform("views", lambda view, i: F.sha2(F.concat(F.get(colours, i), F.lit("|"), around(view)), 256))

    def step(state: Column, _: Column) -> Column:
        grown = F.when(state["done"], state["colours"]).otherwise(refined(state["colours"]))
        return F.struct(grown.alias("colours"), (state["done"] | (F.size(F.array_distinct(grown)) == F.size(F.array_distinct(state["colours"])))).alias("done"))

    most = F.least(F.size("ids"), F.lit(rounds)) if rounds else F.size("ids")
    colours = F.aggregate(F.sequence(F.lit(1), most), F.struct(F.col("start").alias("colours"), F.lit(False).alias("done")), step)["colours"]
    rows = rows.withColumn("colours", colours)
    at = lambda node: F.get("colours", (F.array_position("ids", node) - 1).cast("int"))
    edges = F.array_join(F.array_sort(F.transform("es", lambda e: F.concat_ws("/", at(e["src"]), e["kind"], at(e["dst"])))), ",")
    return rows.select("graph_id", sha(F.array_join(F.array_sort("colours"), ","), edges).alias("signature"), F.size("ids").cast("long").alias("n_nodes"), F.col("n_relations").cast("long").alias("n_relations"))


def census(shapes: DataFrame, owners: DataFrame) -> DataFrame:
    """signature, accounts, thoughts, relations: over the graphs that have an owner."""
    return shapes.join(owners, "graph_id").groupBy("signature").agg(F.count_distinct("user_id").alias("accounts"), F.count("*").alias("thoughts"), F.max("n_relations").alias("relations"))


# A shape is a habit, not a signature, when it is too small, seen too rarely or shared too widely.
CENSUS_RELATIONS, CENSUS_ACCOUNTS, CENSUS_SHARE = 3, 12, 0.25


def census_verdict(counts: DataFrame, owners: DataFrame) -> DataFrame:
    everyone = owners.agg(F.count_distinct("user_id").alias("everyone"))
    share = F.col("accounts") / F.col("everyone")
    verdict = F.when(F.col("relations") < CENSUS_RELATIONS, "too_small").when(F.col("accounts") < CENSUS_ACCOUNTS, "coincidence").when(share < CENSUS_SHARE, "popular").otherwise("signature")
    return counts.crossJoin(F.broadcast(everyone)).select("signature", "accounts", "thoughts", "relations", F.round(share, 6).alias("share"), verdict.alias("verdict"))


def census_summary(counts: DataFrame, minimum: int = 3) -> DataFrame:
    """Shapes of fewer accounts than minimum are folded into one row; shares to two places."""
    rows = counts.select(F.when(F.col("accounts") >= minimum, F.col("signature")).otherwise("(other)").alias("signature"), "accounts", "thoughts")
    folded = rows.groupBy("signature").agg(F.sum("accounts").alias("accounts"), F.sum("thoughts").alias("thoughts"), F.count("*").alias("shapes"))
    total = folded.agg(F.sum("thoughts").alias("total"))
    return folded.crossJoin(F.broadcast(total)).select("signature", "accounts", "thoughts", "shapes", F.bround(F.col("thoughts") / F.col("total"), 2).alias("share"))


def motif_rarity(keys: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """graph_id, rarity: mean of idf over ln(n + 1) of a graph's keys, 1 for keys not seen; between 0 and 1."""
    top = F.log(F.lit(float(n + 1)))
    if n <= 1:
        return keys.select("graph_id").distinct().select("graph_id", F.lit(1.0).alias("rarity"))
    return keys.join(stats.select("key", "idf"), "key", "left").groupBy("graph_id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(F.coalesce("idf", top) / top))).alias("rarity"))


def positional_roles(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, node, positional: a role guessed from the types of a node's relations, the first rule that holds."""
    flag = lambda end, kinds: relations.groupBy("graph_id", F.col(end).alias("node")).agg(*[F.max((F.col("type") == t).cast("int")).alias(f"{end}_{t}") for t in kinds])
    wide = nodes.join(flag("src", ("causes", "prevents", "requires", "constrains", "supports")), ["graph_id", "node"], "left").join(flag("dst", ("causes", "prevents", "requires")), ["graph_id", "node"], "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    role = F.when(has("src_constrains"), "constraint").when(has("src_supports"), "evidence").when(has("src_prevents"), "method").when(has("dst_requires"), "resource")
    role = role.when(has("dst_prevents"), "problem").when(has("src_causes") & has("dst_causes"), "mechanism").when(has("dst_causes"), "outcome").when(has("src_causes"), "state")
    return wide.select("graph_id", "node", role.alias("positional"))


def thought_fingerprint(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """graph_id, fingerprint: of labels, roles, assertions and modalities of nodes ('' where nodes have none) and label-resolved
    relations, whatever the ids and their order."""
    said = [c for c in ("assertion", "modality") if c in nodes.columns]
    return thoughts_of(pack(nodes.select("graph_id", "node", "role", "label", *said), relations), *said)


def thoughts_of(graphs: DataFrame, *said: str) -> DataFrame:
    """The same of graphs as rows; said: those of assertion and modality that their nodes have."""
    more = lambda n: [F.coalesce(n[c], F.lit("")) if c in said else F.lit("") for c in ("assertion", "modality")]
    joined = lambda items: F.array_join(F.sort_array(items), ",")
    dots = joined(F.transform("ns", lambda n: F.concat_ws("/", n["label"], n["role"], *more(n))))

    def edges(ids: Column) -> Column:
        label = lambda n: F.get("ns", _place(ids, n))["label"]
        known = F.filter("es", lambda e: F.array_contains(ids, e["src"]) & F.array_contains(ids, e["dst"]))
        return joined(F.transform(known, lambda e: F.concat_ws("/", label(e["src"]), e["type"], label(e["dst"]), e["assertion"], e["modality"])))

    return graphs.select("graph_id", sha(dots, let(_ids(), edges)).alias("fingerprint"))


def connected_relations(relations: DataFrame) -> DataFrame:
    """graph_id, component (its nodes), relations: relations of a graph that shared nodes connect.

    A graph's relations are a bounded list; they are folded inside one expression, each joining the sets that it touches.
    """
    empty = F.array().cast("array<array<int>>")

    def join(sets: Column, r: Column) -> Column:
        touched = lambda s: F.array_contains(s, r["src"]) | F.array_contains(s, r["dst"])
        return F.array_append(F.filter(sets, lambda s: ~touched(s)), F.array_union(F.array(r["src"], r["dst"]), F.flatten(F.filter(sets, touched))))

    folded = relations.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("rel", "src", "dst"))).alias("rels"))
    sets = folded.select("graph_id", "rels", F.explode(F.aggregate("rels", empty, join)).alias("component"))
    return sets.select("graph_id", F.array_sort("component").alias("component"), F.filter("rels", lambda r: F.array_contains(F.col("component"), r["src"])).alias("relations"))


def duplicates(prints: DataFrame) -> DataFrame:
    """graph_id, first: graphs whose fingerprint an earlier one has."""
    w = Window.partitionBy("fingerprint")
    return prints.withColumn("first", F.min("graph_id").over(w)).filter("graph_id <> first").select("graph_id", "first")


def concept_fingerprints(found: DataFrame, nodes: DataFrame, classes: DataFrame, related: DataFrame | None = None, most: int = 3) -> DataFrame:
    """graph_id, key, a, b: keys of class pairs on paths of at most two steps, and of single nodes.

    classes: (graph_id, node, class), of which the first ``most`` by name count; related (a, b): classes a query is widened by.
    """
    from pyspark.sql import Window

    first = classes.filter(~F.col("class").startswith("DOMAIN_")).withColumn("n", F.row_number().over(Window.partitionBy("graph_id", "node").orderBy("class"))).filter(F.col("n") <= most).drop("n")
    if related is not None:
        more = first.join(F.broadcast(related.filter("weight >= 0.6").select(F.col("a").alias("class"), F.col("b").alias("wider"))), "class").select("graph_id", "node", F.col("wider").alias("class"))
        first = first.unionByName(more).distinct()
    named = kept(first.join(nodes.select("graph_id", "node", "role"), ["graph_id", "node"]).select("graph_id", "node", F.concat_ws(":", "role", "class").alias("d")))
    at = lambda end: named.select("graph_id", F.col("node").alias(end), F.col("d").alias(f"d_{end}"))
    pairs = found.filter("hops <= 2").join(at("a"), ["graph_id", "a"]).join(at("b"), ["graph_id", "b"]).select("graph_id", sha(F.lit("C2"), "d_a", "path", "d_b").alias("key"), "a", "b")
    return pairs.unionByName(named.select("graph_id", sha(F.lit("C1"), "d").alias("key"), F.col("node").alias("a"), F.col("node").alias("b")))


def concept_keys_of(graphs: DataFrame) -> DataFrame:
    """graph_id, keys (array of key, a, b): the same keys of graphs as rows, whose nodes have their classes (an array, see
    lexicon.widened)."""

    def keys(ids: Column, views: Column, said: Column) -> Column:
        told = lambda n: F.get(said, _place(ids, n))
        ends = F.filter(_walked(views, 2), lambda x: F.array_contains(ids, x["a"]))
        key = lambda x, da, db: F.struct(sha(F.lit("C2"), da, x["path"], db).alias("key"), x["a"].alias("a"), x["b"].alias("b"))
        pairs = F.flatten(F.transform(ends, lambda x: F.flatten(F.transform(told(x["a"]), lambda da: F.transform(told(x["b"]), lambda db: key(x, da, db))))))
        single = F.flatten(F.transform("ns", lambda n, i: F.transform(F.get(said, i), lambda d: F.struct(sha(F.lit("C1"), d).alias("key"), n["node"].alias("a"), n["node"].alias("b")))))
        return F.concat(pairs, single)

    said = F.transform("ns", lambda n: F.transform(n["classes"], lambda c: F.concat_ws(":", n["role"], c)))
    found = let(_ids(), lambda ids: let(_views(ids, F.col("es")), lambda views: let(said, lambda said: keys(ids, views, said))))
    return graphs.select("graph_id", found.alias("keys"))
