"""Queries over labels, documents and embeddings, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon, stem, text
from ..operators import labels as label_ops
from ..operators import validate
from ..sources import derived, fixtures
from ..sources.scratch import kept


#: Russian words and their stems as published for Snowball.
RUSSIAN = {"насосы": "насос", "книгами": "книг", "важная": "важн", "читали": "чита", "нагрузка": "нагрузк", "тепло": "тепл", "красивый": "красив", "дома": "дом"}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return derived.table(spark, d, "documents").select("doc_id", "text")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return derived.table(spark, d, "part").select(F.col("p_name").alias("label")).distinct()


def _label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the distinct labels, a dimension of fixed size."""
    a = _labels(spark, d)
    return a.select(F.col("label").alias("label_a")).crossJoin(F.broadcast(a.select(F.col("label").alias("label_b"))))


def d1_split_words(spark, d):
    words = text.split_words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(words).cast("long").alias("n"), F.try_element_at(words, F.lit(1)).alias("first"), F.try_element_at(words, F.lit(-1)).alias("last"))


def d2_stems(spark, d):
    """English stems of distinct words of labels, joined back."""
    return stem.stem_labels(_labels(spark, d)).select("label", F.array_join("stems", " ").alias("stems"))


def d4_script_dispatch(spark, d):
    """Which stemmer the words of documents go to: how many of each document's distinct words are Russian, with a Russian word
    that each text gets."""
    words = F.array_union(F.array_distinct(text.split_words(F.col("text"))), F.array(F.lit("тепло"), F.lit("ёлка")))
    return _docs(spark, d).select("doc_id", F.size(words).cast("long").alias("n"), F.size(F.filter(words, text.is_cyrillic)).cast("long").alias("russian"))


def d3_russian_stems(spark, d):
    """Russian stems beside documents: each gets one of a few words by its id."""
    word = F.element_at(F.array(*[F.lit(w) for w in RUSSIAN]), (F.col("doc_id") % len(RUSSIAN) + 1).cast("int"))
    words = _docs(spark, d).select("doc_id", word.alias("word"))
    return words.select("doc_id", "word", stem.stem_word("word").alias("stem"))


def d6_concepts(spark, d):
    return _label_classes(spark, d).select("label", F.array_join("concepts", ",").alias("concepts"))


def d9_trigrams(spark, d):
    return _labels(spark, d).select("label", F.explode(text.counts(text.trigrams(F.col("label")))).alias("g")).select("label", F.col("g.item").alias("gram"), F.col("g.n").cast("long").alias("n"))


def d10_cosine(spark, d):
    grams = lambda c: text.counts(text.trigrams(F.col(c)))
    return _label_pairs(spark, d).select("label_a", "label_b", F.round(text.cosine(grams("label_a"), grams("label_b")), 6).alias("cosine"))


def d11_jaccard(spark, d):
    words = lambda c: F.array_distinct(text.split_words(F.col(c)))
    return _label_pairs(spark, d).select("label_a", "label_b", F.round(text.jaccard(words("label_a"), words("label_b")), 6).alias("jaccard"))


def _label_classes(spark: SparkSession, d: str) -> DataFrame:
    terms = lexicon.default_terms(spark).unionByName(spark.createDataFrame(list(derived.PART_TERMS), "term string, class string"))
    return kept(lexicon.label_concepts(_labels(spark, d), terms))


def d12_relatedness(spark, d):
    """How related the classes of two labels of parts are, over all pairs of labels."""
    known = _label_classes(spark, d).select("label", F.explode("concepts").alias("class"))
    met = known.select(F.col("class").alias("a")).crossJoin(F.broadcast(known.select(F.col("class").alias("b")))).groupBy("a", "b").agg(F.count("*").alias("n"))
    return met.join(lexicon.relatedness(spark), ["a", "b"], "left").select("a", "b", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def d13_soft_overlap(spark, d):
    known = _label_classes(spark, d)
    pairs = known.select(F.col("label").alias("label_a"), F.col("concepts").alias("a")).crossJoin(F.broadcast(known.select(F.col("label").alias("label_b"), F.col("concepts").alias("b"))))
    named = pairs.select(F.concat_ws("~", "label_a", "label_b").alias("id"), "a", "b")
    return lexicon.soft_overlap(named).select("id", F.round("overlap", 6).alias("overlap"))


def part_features(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """Stems, trigrams and classes of distinct labels, by the terms that parts' names need."""
    terms = lexicon.default_terms(spark).unionByName(spark.createDataFrame(list(derived.PART_TERMS), "term string, class string"))
    return kept(label_ops.features(labels, lexicon.label_concepts(labels, terms)))


def d14_compare(spark, d):
    """Every label of a part with every other."""
    labels = _labels(spark, d)
    got = label_ops.compare(_label_pairs(spark, d), part_features(spark, labels))
    return got.select("label_a", "label_b", *[F.round(c, 6).alias(c) for c in ("lexical", "trigram", "surface", "concept", "domain", "fused")])


def d14_encoder_evidence(spark, d):
    """The same with an encoder's opinion of pairs: labels in order of their names are told by the vectors of their number, and
    three times the size of a cosine stands for it, as vectors of the table are far apart."""
    labels = _labels(spark, d)
    vectors = derived.table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("v"))
    numbered = labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("n"))  # a dimension of fixed size
    told = label_ops.encoder_relatedness(_label_pairs(spark, d), numbered.join(vectors, "n").select("label", "v"), scale=3.0)
    got = label_ops.compare(_label_pairs(spark, d), part_features(spark, labels), told)
    return got.select("label_a", "label_b", *[F.round(c, 5).alias(c) for c in ("surface", "concept", "fused")])


def g7_part_twins(spark, d):
    """The likest other label of each part's label, from a surface of 0.45 on."""
    return label_ops.best_twin(label_ops.twins(part_features(spark, _labels(spark, d)), 0.45)).select("label", "twin", F.round("surface", 6).alias("surface"))


def g7_opening_twins(spark, d):
    """Documents' openings, six words each, with the likest other opening."""
    opening = F.array_join(F.slice(text.split_words(F.col("text")), 1, 6), " ")
    labels = kept(_docs(spark, d).select(opening.alias("label")).distinct()).filter("label <> ''")  # texts are read once
    return label_ops.best_twin(label_ops.twins(kept(label_ops.features(labels)))).select("label", "twin", F.round("surface", 6).alias("surface"))


def d15_scrub(spark, d):
    rows = _docs(spark, d).filter(text.contains_pii(F.col("text")))
    return rows.select("doc_id", F.length(text.scrub(F.col("text"))).alias("n"), F.size(F.split(text.scrub(F.col("text")), r"\[redacted\]")).alias("parts"))


def d16_scripts(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(text.scripts(F.col("text")), ",").alias("scripts"), F.size(text.uncovered_scripts(F.col("text"))).cast("long").alias("uncovered"))


def d17_slug(spark, d):
    return _labels(spark, d).select("label", text.slug(F.col("label")).alias("slug"))


def d18_digests(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


def d20_hashed_vectors(spark, d):
    labels = _labels(spark, d)
    terms = lexicon.default_terms(spark).unionByName(spark.createDataFrame(list(derived.PART_TERMS), "term string, class string"))
    rows = stem.stem_labels(labels).withColumnRenamed("stems", "words").join(lexicon.label_concepts(labels, terms).withColumnRenamed("concepts", "classes"), "label")
    rows = rows.withColumn("grams", text.counts(text.trigrams(F.col("label"))))
    return text.hashed_vectors(rows).select("label", "slot", F.round("value", 6).alias("value"))


def d21_encoder_cosine(spark, d):
    """Neighbouring embeddings: cosine and its rescaled similarity."""
    e = derived.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    cos = text.dot(F.col("v"), F.col("w")) / F.sqrt(text.dot(F.col("v"), F.col("v")) * text.dot(F.col("w"), F.col("w")))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cos, 5).alias("cosine"), F.round(text.rescale(F.abs(cos) * 3), 4).alias("similarity"))


def _thoughts(spark, d) -> DataFrame:
    return derived.thoughts(kept(derived.order_lines(spark, d)))


def b1_issues(spark, d):
    """All that is wrong with orders as nested graphs, some of which are spoilt by their number."""
    n = F.col("thought_id").cast("long")
    node = lambda i, f, x: F.transform("nodes", lambda v, k: F.when(k == i, v.withField(f, x(v))).otherwise(v))
    spoilt = _thoughts(spark, d).withColumn("nodes", F.when(n % 11 == 0, node(1, "role", lambda v: F.lit("weather"))).otherwise(F.col("nodes")))
    moved = lambda v: F.transform(v["spans"], lambda s: s.withField("start", s["start"] + 1).withField("end", s["end"] + 1))
    spoilt = spoilt.withColumn("nodes", F.when(n % 13 == 0, node(0, "spans", moved)).otherwise(F.col("nodes")))
    bad_ref = lambda v: v["knowledge"].withField("about", F.transform(v["knowledge"]["about"], lambda r: r.withField("id", F.lit("no colon"))))
    spoilt = spoilt.withColumn("nodes", F.when(n % 23 == 0, node(0, "knowledge", bad_ref)).otherwise(F.col("nodes")))
    ends = F.transform("relations", lambda r, k: F.when(k == 0, r.withField("target", F.lit("n999"))).otherwise(r))
    spoilt = spoilt.withColumn("relations", F.when(n % 17 == 0, ends).otherwise(F.col("relations")))
    spoilt = spoilt.withColumn("source", F.when(n % 19 == 0, F.col("source").withField("sha256", F.lit("0" * 64))).otherwise(F.col("source")))
    spoilt = spoilt.withColumn("provenance", F.when(n % 29 == 0, F.col("provenance").withField("kind", F.lit("guess"))).otherwise(F.col("provenance")))
    return validate.issues(spoilt)


def b5_source_sha(spark, d):
    """Documents whose stated digest doesn't hold: every tenth is spoilt."""
    rows = _docs(spark, d).select("doc_id", "text", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return rows.filter(F.sha2("text", 256) != F.col("sha")).select("doc_id")


def b2_grounding(spark, d):
    """Spans cut from documents hold unless they were moved."""
    rows = _docs(spark, d).select("doc_id", "text", (F.col("doc_id") % 10).cast("int").alias("start"))
    rows = rows.select("doc_id", "text", "start", F.substr("text", F.col("start") + 1 + (F.col("doc_id") % 4 == 0).cast("int"), F.lit(12)).alias("span"))
    return rows.select("doc_id", (F.substr("text", F.col("start") + 1, F.lit(12)) == F.col("span")).alias("grounded"))


def b6_canonical(spark, d):
    """The canonical digest of orders as nested graphs, and whether it stays when nodes and relations are turned round."""
    graphs = _thoughts(spark, d)
    turned = validate.canonical(graphs.withColumns({"nodes": F.reverse("nodes"), "relations": F.reverse("relations")})).select("thought_id", F.col("sha").alias("other"))
    return validate.canonical(graphs).join(turned, "thought_id").groupBy((F.col("sha") == F.col("other")).alias("same")).agg(F.count("*").alias("graphs"), F.count_distinct("sha").alias("digests"))


def b7_helper_ids(spark, d):
    return derived.table(spark, d, "region").select("r_name", validate.helper_id("t_", F.lit(""), F.col("r_name")).alias("id"))


def b11_payload_bounds(spark, d):
    return _docs(spark, d).select("doc_id", (F.octet_length("text") <= 65536).alias("bytes_ok"), (F.length("text") <= 20000).alias("chars_ok"))


def b13_control_fields(spark, d):
    e = derived.table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, F.lit('{"owner": 1, "k": 2}')).otherwise(F.col("props")).alias("payload"))
    return validate.control_fields(e).select("id", F.array_join("fields", ",").alias("fields"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] in "bdg" and k[1:2].isdigit()}

PAIRS = "labels AS (SELECT DISTINCT p_name AS label FROM part), pairs AS (SELECT a.label AS label_a, b.label AS label_b FROM labels a, labels b)"
GRAMS = """words AS (SELECT label, regexp_extract_all(lower(label), '[\\p{L}\\p{N}]+') AS w FROM labels), padded AS (SELECT label, ' ' || array_to_string(w, ' ') || ' ' AS p FROM words),
grams AS (SELECT label, gram, count(*) AS n FROM (SELECT label, substr(p, i, 3) AS gram FROM (SELECT label, p, unnest(generate_series(1, length(p) - 2)) AS i FROM padded)) GROUP BY ALL), norms AS (SELECT label, sqrt(sum(n * n)) AS norm FROM grams GROUP BY label),
cosines AS (SELECT p.label_a, p.label_b, coalesce(x.dot, 0) / (a.norm * b.norm) AS cosine FROM pairs p JOIN norms a ON a.label = label_a JOIN norms b ON b.label = label_b
  LEFT JOIN (SELECT g.label AS la, h.label AS lb, sum(g.n * h.n) AS dot FROM grams g JOIN grams h ON g.gram = h.gram GROUP BY ALL) x ON x.la = label_a AND x.lb = label_b),
jac AS (SELECT label_a, label_b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS jaccard FROM pairs JOIN words a ON a.label = label_a JOIN words b ON b.label = label_b)"""

RELATED = "related(a, b, w) AS (VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in lexicon.RELATED) + "), classes(c, w) AS (VALUES " + ", ".join(f"('{c}', {w})" for c, _, w in lexicon.CLASSES) + ")"

#: The stems of all words that parts' names have, and the classes of stems.
STEMS = "stems(word, stem) AS (VALUES " + ", ".join(f"('{w}', '{stem.stem(w)}')" for w in derived.PART_WORDS) + ")"
_TERMS = [(t, c) for t, c in [*derived.PART_TERMS, *((n.removesuffix("_EVENT").removesuffix("_ACTION").lower(), n) for n, _, _ in lexicon.CLASSES)] if "_" not in t]
TERMS = "terms(stem, class) AS (VALUES " + ", ".join(f"('{stem.stem(t)}', '{c}')" for t, c in _TERMS) + ")"
COMPARED = f"""{RELATED}, {STEMS}, {TERMS}, both_ways AS (SELECT a, b, w FROM related UNION SELECT b, a, w FROM related),
stemmed AS (SELECT label, list(stem ORDER BY i) AS s FROM (SELECT label, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words) JOIN stems USING (word) GROUP BY label),
lexical AS (SELECT label_a, label_b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS lexical FROM pairs JOIN stemmed a ON a.label = label_a JOIN stemmed b ON b.label = label_b),
kinds AS (SELECT DISTINCT label, class FROM (SELECT label, unnest(s) AS stem FROM stemmed) JOIN terms USING (stem)),
sides AS (SELECT label_a, label_b, x.class, max(CASE WHEN x.class = y.class THEN 1.0 ELSE coalesce(r.w, 0) END) AS best, 0 AS side FROM pairs JOIN kinds x ON x.label = label_a JOIN kinds y ON y.label = label_b LEFT JOIN both_ways r ON r.a = x.class AND r.b = y.class GROUP BY ALL
  UNION ALL SELECT label_a, label_b, y.class, max(CASE WHEN x.class = y.class THEN 1.0 ELSE coalesce(r.w, 0) END), 1 FROM pairs JOIN kinds x ON x.label = label_a JOIN kinds y ON y.label = label_b LEFT JOIN both_ways r ON r.a = x.class AND r.b = y.class GROUP BY ALL),
concepts AS (SELECT label_a, label_b, sum(c.w * s.best) / sum(c.w) AS concept FROM sides s JOIN classes c ON c.c = s.class GROUP BY ALL),
surfaces AS (SELECT label_a, label_b, lexical, cosine AS trigram, greatest(lexical, CASE WHEN cosine > 0.5 THEN 0.85 * cosine ELSE 0.6 * cosine END) AS surface, coalesce(concept, 0.0)::DOUBLE AS concept
  FROM cosines JOIN lexical USING (label_a, label_b) LEFT JOIN concepts USING (label_a, label_b)),
compared AS (SELECT *, least(1.0, greatest(surface, 0.9 * concept, 0.5 * surface + 0.5 * concept)) AS fused FROM surfaces)"""

HINTS = "hints(class, role) AS (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in lexicon.role_of().items() if r) + ")"

ORACLES = {
    "d2_stems": f"WITH {PAIRS}, {GRAMS}, {COMPARED} SELECT label, array_to_string(s, ' ') AS stems FROM stemmed",
    "d6_concepts": f"WITH {PAIRS}, {GRAMS}, {COMPARED} SELECT l.label, coalesce(string_agg(k.class, ',' ORDER BY k.class), '') AS concepts FROM labels l LEFT JOIN kinds k ON k.label = l.label GROUP BY l.label",
    "d14_encoder_evidence": f"""WITH {PAIRS}, {GRAMS}, {COMPARED}, numbered AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS n FROM labels), vectors AS (SELECT numbered.label, CAST(embedding AS DOUBLE[]) AS v FROM numbered JOIN embeddings ON vec_id = n),
told AS (SELECT a.label AS label_a, b.label AS label_b, 3 * abs(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) AS c FROM vectors a, vectors b),
scaled AS (SELECT label_a, label_b, CASE WHEN c <= 0.78 THEN 0.0 WHEN c >= 0.93 THEN 1.0 ELSE (c - 0.78) / (0.93 - 0.78) END AS r FROM told),
raised AS (SELECT label_a, label_b, CASE WHEN r >= 0.6 THEN greatest(surface, r) ELSE surface END AS surface, greatest(concept, coalesce(r, 0)) AS concept FROM compared LEFT JOIN scaled USING (label_a, label_b))
SELECT label_a, label_b, round(surface, 5) AS surface, round(concept, 5)::DOUBLE AS concept, round(least(1.0, greatest(surface, 0.9 * concept, 0.5 * surface + 0.5 * concept)), 5)::DOUBLE AS fused FROM raised""",
    "g7_part_twins": f"""WITH {PAIRS}, {GRAMS}, {COMPARED} SELECT label_a AS label, label_b AS twin, round(surface, 6) AS surface FROM (
  SELECT *, row_number() OVER (PARTITION BY label_a ORDER BY round(surface, 9) DESC, label_b) AS k FROM compared WHERE label_a <> label_b AND surface >= 0.45 - 1e-9) WHERE k = 1""",
    "d12_relatedness": f"""WITH {PAIRS}, {GRAMS}, {COMPARED} SELECT x.class AS a, y.class AS b, count(*) AS n, max(CASE WHEN x.class = y.class THEN 1.0 ELSE coalesce(r.w, 0.0) END)::DOUBLE AS weight FROM kinds x, kinds y LEFT JOIN both_ways r ON r.a = x.class AND r.b = y.class GROUP BY ALL""",
    "d13_soft_overlap": f"WITH {PAIRS}, {GRAMS}, {COMPARED} SELECT label_a || '~' || label_b AS id, round(concept, 6)::DOUBLE AS overlap FROM compared",
    "d3_russian_stems": "SELECT doc_id, w.word, w.stem FROM documents JOIN (VALUES " + ", ".join(f"({i}, '{w}', '{s}')" for i, (w, s) in enumerate(RUSSIAN.items())) + f") w(i, word, stem) ON i = doc_id % {len(RUSSIAN)}",
    "d4_script_dispatch": "SELECT doc_id, CAST(len(list_distinct(list_concat(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['тепло', 'ёлка']))) AS BIGINT) AS n, CAST(len(list_filter(list_distinct(list_concat(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['тепло', 'ёлка'])), lambda w: regexp_matches(w, '[\\x{0400}-\\x{04ff}]'))) AS BIGINT) AS russian FROM documents",
    "d9_trigrams": f"WITH {PAIRS}, {GRAMS} SELECT label, gram, n FROM grams",
    "d10_cosine": f"WITH {PAIRS}, {GRAMS} SELECT label_a, label_b, round(cosine, 6) AS cosine FROM cosines",
    "d11_jaccard": f"WITH {PAIRS}, {GRAMS} SELECT label_a, label_b, round(jaccard, 6) AS jaccard FROM jac",
    "d14_compare": f"""WITH {PAIRS}, {GRAMS}, {COMPARED} SELECT label_a, label_b, round(lexical, 6) AS lexical, round(trigram, 6) AS trigram, round(surface, 6) AS surface, round(concept, 6)::DOUBLE AS concept, 0.0::DOUBLE AS domain, round(fused, 6)::DOUBLE AS fused FROM compared""",
    "d16_scripts": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '[\\x{{{low:04x}}}-\\x{{{high:04x}}}]') THEN '{n}' END" for n, low, high in text.SCRIPTS) + "], lambda x: x IS NOT NULL), ',') AS scripts, "
    + " + ".join(f"CAST(regexp_matches(text, '[\\x{{{low:04x}}}-\\x{{{high:04x}}}]') AS BIGINT)" for n, low, high in text.SCRIPTS[2:]) + " AS uncovered FROM documents",
    "d17_slug": "SELECT DISTINCT p_name AS label, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM part",
    "d18_digests": "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 16) AS short FROM documents",
    "d20_hashed_vectors": f"""WITH {PAIRS}, {GRAMS}, {COMPARED}, tokens AS (SELECT label, 's:' || stem AS t, 1.0::DOUBLE AS v FROM (SELECT label, unnest(s) AS stem FROM stemmed) UNION ALL SELECT label, 'c:' || class, 1.5 FROM kinds UNION ALL SELECT label, 'g:' || gram, 0.3 * n FROM grams),
slots AS (SELECT label, CAST(('0x' || substr(sha256(t), 1, 8))::BIGINT % 256 AS INT) AS slot, sum(v) AS value FROM tokens GROUP BY ALL)
SELECT label, slot, round(value / sqrt(sum(value * value) OVER (PARTITION BY label)), 6) AS value FROM slots""",
    "d21_encoder_cosine": """SELECT vec_id, round(c, 5) AS cosine, round(CASE WHEN abs(c) * 3 <= 0.78 THEN 0.0 WHEN abs(c) * 3 >= 0.93 THEN 1.0 ELSE (abs(c) * 3 - 0.78) / (0.93 - 0.78) END, 4) AS similarity
FROM (SELECT a.vec_id, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS c FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1)""",
    "b2_grounding": "SELECT doc_id, substr(text, CAST(doc_id % 10 AS INT) + 1, 12) = substr(text, CAST(doc_id % 10 AS INT) + 1 + CAST(doc_id % 4 = 0 AS INT), 12) AS grounded FROM documents",
    "b5_source_sha": "SELECT doc_id FROM documents WHERE doc_id % 10 = 0",
    "b7_helper_ids": """SELECT r_name, 't_' || substr(sha256('["","' || r_name || '"]'), 1, 20) AS id FROM region""",
    "b11_payload_bounds": "SELECT doc_id, octet_length(encode(text)) <= 65536 AS bytes_ok, length(text) <= 20000 AS chars_ok FROM documents",
    "b13_control_fields": "SELECT event_id AS id, 'owner' AS fields FROM events WHERE event_id % 9 = 0",
}
