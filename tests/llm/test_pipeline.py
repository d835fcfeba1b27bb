"""The pipeline against a brute-force version of its stages."""

import random
from fractions import Fraction

import numpy as np

import corpus_pipeline
from graphspan.llm import decontam, packing, secrets
from graphspan.llm.common import stored

from .test_operators import brute_join, crc, tokens


def test_pipeline(spark, tmp_path):
    r = random.Random(9)
    en = [a + b for a in ("th", "wh", "st", "bl") for b in ("e", "ing", "ion", "at", "ose", "ick")]
    say = lambda n: " ".join(r.choice(en) for _ in range(n))
    base, leak = say(80), say(30)
    docs = [(i, say(50) + f" {i}", "en", f"s{i % 4}", 0) for i in range(40)]
    docs += [(100, base, "en", "s0", 0), (101, base, "en", "s1", 0), (102, base + " tail", "en", "s2", 0), (103, "12 34 !!", "en", "s0", 0), (104, None, "en", "s0", 0), (105, say(9) + " " + leak[:90] + " " + say(9), "en", "s3", 0)]
    docs += [(106, f"the token = abcdef123456 and {say(20)}", "en", "s1", 0), (107, "the", "en", None, 0), (None, say(30), None, "s1", None)]
    docs += [(110 + i, f"{say(20)} password: changeme99 {i}", "en", f"s{i}", 0) for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(d[0], d[1]) for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    component = {d: c for d, _, c, _ in brute_join(left, Fraction(8, 10), 5)}
    left = [(d, t) for d, t in left if d is None or component[d] == d]
    windows = {tuple(decontam.words(leak)[i : i + 10]) for i in range(21)}
    left = [(d, t) for d, t in left if not any(tuple(decontam.words(t)[i : i + 10]) in windows for i in range(len(decontam.words(t)) - 9))]

    def hidden(text):
        out, at = "", 0
        for kind, b, e, value in secrets.base_spans(text):
            if b >= at and value != "changeme99":
                out, at = out + text[at:b] + f"[{secrets.KINDS[kind]}]", e
        return out + text[at:]

    expected = []
    for d, t in left:
        ids, at = tokens(hidden(t), 0), 0
        for n in packing.piece_lengths(np.array([len(ids)]))[0].tolist():
            expected.append((d, at, n, crc(ids[at : at + n]), len(ids)))
            at += n
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "secret_scan", "packing"]


def test_stages_decide_by_row(spark, tmp_path):
    """Rows without a doc_id are dropped and masked like others; rows that share one are told apart."""
    r = random.Random(4)
    en = [a + b for a in ("th", "wh", "st", "bl") for b in ("e", "ing", "ion", "at", "ose", "ick")]
    say = lambda n: " ".join(r.choice(en) for _ in range(n))
    leak, twin, copy = say(30), say(60), say(60)
    clean = [say(40) for _ in range(4)]
    docs = [(None, "12 34 !!"), (None, say(9) + " " + leak), (5, say(9) + " " + leak), (5, clean[0]), (6, twin), (None, twin), (7, copy), (7, copy), (7, clean[1])]
    docs += [(None, f"{clean[2]} password=hunter22secret"), (8, f"{clean[3]} token: abcdef123456"), (8, clean[3][:90])]
    at = str(tmp_path / "documents.parquet")
    rows = [(i, t, "en", f"s{k % 3}", 0) for k, (i, t) in enumerate(docs)] + [(100 + k, say(30), "en", "s0", 0) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(at)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(5, clean[0]), (6, twin), (7, copy), (7, clean[1]), (8, clean[3][:90]), (8, f"{clean[3]} [assign]"), (None, f"{clean[2]} [assign]")]
    for held in (False, True):  # a plain scan, and rows that come from elsewhere
        left = spark.read.parquet(at).filter("true") if held else spark.read.parquet(at)
        for _, stage in corpus_pipeline.STAGES[:4]:
            left = stage(spark, left, str(tmp_path))
            assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if not held:
                left, _ = stored(left, "stage")
        got = [(x["doc_id"], x["text"]) for x in left.collect() if x["doc_id"] is None or x["doc_id"] < 100]
        assert sorted(got, key=repr) == sorted(kept, key=repr)


def test_stages_on_awkward_tables(spark, tmp_path):
    """Columns that clash with the stages' own names, very long texts, empty tables."""
    r = random.Random(6)
    en = [a + b for a in ("th", "wh", "st", "bl") for b in ("e", "ing", "ion", "at", "ose", "ick")]
    say = lambda n: " ".join(r.choice(en) for _ in range(n))
    long, leak = say(60000), say(30)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _gone string, _values string, _file string, row string, first string, owner string, spans string"
    texts = [long, long + " end", f"{say(30)} password=hunter22secret {say(20000)}", f"{say(20000)} {leak}", say(50)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *["x"] * 8) for i, t in enumerate(texts)], schema)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for at, rows in (("full", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / at))
        left = spark.read.parquet(str(tmp_path / at))
        for _, stage in corpus_pipeline.STAGES[:4]:
            left, _ = stored(stage(spark, left, str(tmp_path)), "stage")
            assert left.columns == docs.columns
        got = {x["doc_id"]: (x["text"], x["_row"], x["_values"]) for x in left.collect()}
        masked = texts[2].replace("password=hunter22secret", "[assign]")
        assert got == ({} if at == "none" else {0: (long, "x", "x"), 2: (masked, "x", "x"), 4: (texts[4], "x", "x")})
        packed = corpus_pipeline.STAGES[4][1](spark, left, str(tmp_path))
        assert (packed.count() > 0) == (at == "full")
