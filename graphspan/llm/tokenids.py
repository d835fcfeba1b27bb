"""Encoding of whole texts to ids, with the work on repeated words done once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_tables

#: Bytes of text encoded at once: the more, the fewer look-ups of distinct chunks.
ENCODE_BYTES = 8 << 20

# Unicode White_Space beyond ASCII, as the byte-level pattern's \\s has it.
_WIDE_SPACES = ["\u0085", "\u00a0", "\u1680", *(chr(0x2000 + i) for i in range(11)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
#: Bytes of wide spaces after their first one, by that.
_WIDE = {lead: np.array([[*c.encode()[1:]] for c in _WIDE_SPACES if c.encode()[0] == lead], np.uint8) for lead in {c.encode()[0] for c in _WIDE_SPACES}}
_SPACE, _LETTER, _DIGIT, _MARK = 1, 2, 3, 4
#: Kinds of bytes; 0 for bytes beyond ASCII, control characters and the apostrophe, which may begin a contraction.
_KIND = np.array([_SPACE if i in (9, 10, 11, 12, 13, 32) else 0 if i < 33 or i > 126 or i == 39 else _LETTER if chr(i).isalpha() else _DIGIT if chr(i).isdigit() else _MARK for i in range(256)], np.uint8)


class ChunkEncoder:
    """Ids of texts by a byte-level tokenizer of the tokenizers library.

    Its pattern never lets a piece go on where white space begins, nor from one to another of ASCII letters, digits and
    marks, so a text can be cut there and each chunk encoded by itself.  The distinct chunks of a batch are looked up in two tables of at most
    ``limit`` chunks each: when the newer one is full it becomes the older one, from which chunks that are met again move
    over.  Memory is bounded and the ids are those of the whole text.  A text that holds an added token, and every text for
    a tokenizer that isn't plainly byte-level, is encoded whole.
    """

    def __init__(self, path: str, limit: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        told = json.loads(self.tok.to_str())
        told.pop("model", None)
        pre = told.get("pre_tokenizer") or {}
        self.added = [t["content"].encode() for t in told.get("added_tokens") or []]
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.plain = bool(byte_level) and not told.get("normalizer") and not any(len(t.split()) != 1 for t in self.added)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.opens = {}
        for mark in (b" ", b"\n"):  # tokens that begin with this byte, as the byte-level alphabet writes it
            shown = chr(256 + mark[0])
            self.opens[mark] = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[mark][[i for token, i in vocab.items() if token.startswith(shown)]] = True
        self.line_end = self._whole([b"\n"])[0]
        self.limit = limit
        self.table: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        groups, alone = {b" ": [], b"\n": [], b"": []}, []
        for k in new:
            head = k[:1] if k[:1] in b" \n" else b""
            rest = k[len(head) :]
            spaced = rest.strip() != rest or not rest.isascii() and any(map(str.isspace, rest.decode()))
            alone.append(k) if spaced or not rest else groups[head].append(k)
        for head, keys in groups.items():
            # a chunk that begins with one blank or line end has that in its first token alone; others get a line end before
            opens, skip = self.opens[head or b"\n"], 0 if head else 4
            parts = [keys[i : i + 64] for i in range(0, len(keys), 64)]
            for part, ids in zip(parts, self._whole([(b"" if head else b"\n") + (b"" if head else b"\n").join(p) for p in parts]), strict=True):
                cut = (4 * np.flatnonzero(opens[np.frombuffer(ids, "<u4")])).tolist()
                if len(cut) == len(part) and (head or ids[:4] == self.line_end):
                    self.table.update(zip(part, [ids[a + skip : z] for a, z in zip(cut, [*cut[1:], len(ids)], strict=True)], strict=True))
                else:
                    alone += part
        self.table.update(zip(alone, self._whole(alone), strict=True))

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.table) > self.limit:
            self.table, self.older = {}, self.table
        got = list(map(self.table.get, chunks))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            again = [(chunks[i], x) for i in missing if (x := self.older.get(chunks[i])) is not None]
            self.table.update(again)
            new = [chunks[i] for i in missing]
            self._learn([c for c in new if c not in self.table] if again else new)
            for i in missing:
                got[i] = self.table[chunks[i]]
        return got

    @staticmethod
    def _cuts(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where chunks begin, and the end."""
        kind = _KIND[raw]
        for lead, rest in _WIDE.items():
            at = np.flatnonzero(raw == lead)
            width = 1 + rest.shape[1]
            at = at[at + width <= len(raw)]
            for follow in rest if len(at) else ():
                here = at[np.all([raw[at + 1 + i] == x for i, x in enumerate(follow)], axis=0)]
                for i in range(width):
                    kind[here + i] = _SPACE
        begins = np.zeros(len(raw) + 1, bool)
        here, before = kind[1:], kind[:-1]
        np.logical_and(here > _SPACE, before > _SPACE, out=begins[1:-1])
        begins[1:-1] |= here == _SPACE
        begins[1:-1] &= here != before
        begins[first] = True
        return np.flatnonzero(begins).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text begins and the last ends); null texts are empty."""
        texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
        if self.plain:
            odd = np.unique(np.concatenate([np.flatnonzero(pc.match_substring(texts, t).to_numpy(zero_copy_only=False)) for t in self.added] or [[]])).astype(np.int64).tolist()
        else:
            odd = list(range(len(texts)))
        whole = dict(zip(odd, self._whole([texts[i].as_py().encode() for i in odd]), strict=True))
        if odd:  # the others, with nothing in the place of these
            put = pa.array(np.isin(np.arange(len(texts)), odd))
            texts = pa.concat_arrays([pc.if_else(put, "", texts)])
        first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or first[-1] == first[0]:
            ids, bounds = np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        else:
            buffer = texts.buffers()[2].slice(int(first[0]), int(first[-1] - first[0]))
            first = first - first[0]
            at = self._cuts(np.frombuffer(buffer, np.uint8), first)
            chunks = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), buffer]).dictionary_encode()
            own = np.searchsorted(at, first)
            del at
            taken = pa.array(self._ids(chunks.dictionary.to_pylist()), pa.large_binary()).take(chunks.indices)
            ids = np.frombuffer(taken.buffers()[2], "<u4") if taken.buffers()[2] else np.zeros(0, "<u4")
            bounds = np.frombuffer(taken.buffers()[1], np.int64)[own] // 4
        if not whole:
            return ids, bounds
        parts = [np.frombuffer(whole[i], "<u4") if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder(path: str) -> ChunkEncoder:
    """One per worker process and vocabulary file, while it encodes."""
    if path not in worker_tables:
        worker_tables[path] = ChunkEncoder(path)
    return worker_tables[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, "<u4")
    inside = np.ones(len(out), bool)
    inside[bounds[1:] + np.arange(n)] = False
    out[inside] = ids
    return out, bounds + np.arange(n + 1)
