"""Cross-tokenizer alignment against whole texts encoded one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from graphspan.llm import align
from tests.llm.test_operators import ROWS, docs, empty, rows_of  # noqa: F401

rng = random.Random(6)
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Whole texts, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=SECOND)
    alphabet = {c: x for x, c in enumerate([*map(chr, range(256))])}
    hidden = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x)]
    alphabet |= {chr(256 + k): x for k, x in enumerate(hidden)}
    done, counts = [], Counter()
    for doc, text in rows:
        if not text:
            done.append((doc, None))
            continue
        raw = (" " + text).encode()
        p = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        q = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if b"".join(x for _, x in p) != raw or b"".join(x for _, x in q) != raw:
            done.append((doc, None))
            continue

        def ends(tokens):
            at, out = 0, {}
            for i, x in tokens:
                at += len(x)
                out[at] = i
            return out

        x, y = ends(p), ends(q)
        groups, links, now = [], [], ([], [])
        for at in sorted(x.keys() | y.keys()):
            if at in x:
                now[0].append(x[at])
            if at in y:
                now[1].append(y[at])
            if at in x and at in y:
                groups.append(now)
                links.append((x[at], y[at]))
                now = ([], [])
        counts.update(links)
        done.append((doc, (len(p), len(q), groups, links)))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    out = []
    for doc, x in done:
        if x is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in x[2])
        out.append((doc, x[0], x[1], len(x[2]), len(x[3]), sum(counts[k] == highest[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr), {(i, j, n, n == highest[j]) for (i, j), n in counts.items()}


LETTERS = "abé èèZ09 .,;-'\"!?\n\t\r  　\u0085\x1c\x00😀|<>#▁<s>   "
ODD = [" ", "  ", "a ", " a", "a  ", "a \n b", "a\n  b \n", "x　 y", "<s> <|endoftext|> <0x41> <unk>", "▁a", "a ▁ b", "same words same words", "don't I'll", "  z  ", "日本語 テキスト 한국어", "é \u0000 \x7f"]


def test_awkward_rows(docs, empty, monkeypatch):  # noqa: F811
    assert align.separable(FIRST, SECOND)
    want, pairs = brute(ROWS)
    for size in (align.BLOCK_BYTES, 500):
        monkeypatch.setattr(align, "BLOCK_BYTES", size)
        got, counts = align.align(docs, FIRST, SECOND)
        assert rows_of(got, *COLUMNS) == want
        assert {tuple(r) for r in counts.select("a", "b", "count", "best").collect()} == pairs
    assert align.align(empty, FIRST, SECOND)[0].count() == 0


@pytest.mark.parametrize("apart", [True, False])
def test_odd_texts(spark, monkeypatch, apart):
    texts = ODD + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(align, "separable", lambda a, b: apart)
    got, _ = align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), FIRST, SECOND, with_groups=True)
    assert rows_of(got, *COLUMNS) == brute(rows)[0]
    assert all((hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"] for r in got.collect())
