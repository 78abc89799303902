"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold rank * leaves + position of each adjacent pair
that merges, so the root is the leftmost lowest-rank merge; a merge updates three
leaves and their paths. Many words of like length are encoded side by side, one
tree a row; single or very long words by the same tree one at a time. Chunks
between white space that were met before come from a bounded cache.

The vocabulary is a public file of the tokenizers library whose path is a
parameter; nothing is trained. Text is normalised and split here by the rules of
that file for Latin text, and by the library's own normaliser and pre-tokenizer
where a text has other characters, so that Unicode tables cannot disagree.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, slices

#: Chunks that a worker keeps in each of two generations. A bound of memory only.
CACHE_CHUNKS = 450_000
_NONE = np.iinfo(np.int64).max
#: Fewer words than this of one tree size, or longer ones, go one at a time.
_ROWS, _WIDE = 6, 512


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable, else the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Bpe:
    """A byte-level BPE with word ends, read from a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path, self._library = spec["model"], path, None
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.byte_of = {c: b for b, c in chars.items()}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + end] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.size = size
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._index(keys, made)
        self.of_pair = dict(zip(keys.tolist(), zip(range(len(keys)), made.tolist())))
        self.token = [b""] * size
        for table in (vocab, self.special):
            for word, i in table.items():
                self.token[i] = word.encode()
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # Latin text without format controls: its normal form is itself and white space is what str.split() takes
        self.unusual = re.compile("[^\t-\r -~\xa0-ɏ‐-‧€]")
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- one word ---------------------------------------------------------------

    def _one(self, word: bytes) -> list[int]:
        """ids of a word by its segment tree."""
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        n = len(ids)
        leaves = 1 << max(1, (n - 1).bit_length())
        size, get = self.size, self.of_pair.get
        tree = [_NONE] * (2 * leaves)
        for i in range(n - 1):
            if found := get(ids[i] * size + ids[i + 1]):
                tree[leaves + i] = found[0] * leaves + i
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = leaves + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    return
                tree[k] = least

        def pair(i: int, j: int) -> int:
            found = get(ids[i] * size + ids[j])
            return found[0] * leaves + i if found else _NONE

        while tree[1] != _NONE:
            i = tree[1] % leaves
            j = after[i]
            ids[i] = get(ids[i] * size + ids[j])[1]
            ids[j] = -1
            k = after[i] = after[j]
            put(j, _NONE)
            if k < n:
                before[k] = i
            put(i, pair(i, k) if k < n else _NONE)
            if (h := before[i]) >= 0:
                put(h, pair(h, i))
        return [x for x in ids if x >= 0]

    # -- many words -------------------------------------------------------------

    def _index(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing table of the pairs that merge, at most a quarter full."""
        self.bits = int(4 * len(keys) - 1).bit_length()
        slots = 1 << self.bits
        self.keys, self.rank, self.made = (np.full(slots, -1, np.int64) for _ in range(3))
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.rank[at[first]], self.made[at[first]] = keys[left[first]], left[first], made[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & (slots - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair's merge is in the table, and whether there is one."""
        key = left * self.size + right
        at = self._home(key)
        found = self.keys[at]
        look = np.flatnonzero((found != key) & (found >= 0))
        while len(look):
            at[look] = (at[look] + 1) & (len(self.keys) - 1)
            found[look] = again = self.keys[at[look]]
            look = look[(again != key[look]) & (again >= 0)]
        return at, found == key

    def _many(self, words: list[bytes], leaves: int) -> list[bytes]:
        """ids of words of at most `leaves` bytes, each with a tree of its own, all merged step by step together."""
        n = np.array([len(w) for w in words])
        rows, at = np.repeat(np.arange(len(words)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        wide = leaves + 1
        ids = np.full((len(words), wide), -1, np.int64)
        ids[rows, at] = self.inner[data]
        ends = np.arange(len(words)), n - 1
        ids[ends] = self.final[data[np.cumsum(n) - 1]]
        tree = np.full((len(words), 2 * leaves), _NONE, np.int64)
        has = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        r, i = np.nonzero(has)
        where, ok = self._pairs(ids[r, i], ids[r, i + 1])
        tree[r[ok], leaves + i[ok]] = self.rank[where[ok]] * leaves + i[ok]
        k = leaves
        while k > 1:
            k >>= 1
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        after = np.tile(np.arange(1, wide + 1), (len(words), 1))
        before = np.tile(np.arange(-1, wide - 1), (len(words), 1))

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            k = leaves + i
            tree[r, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        def pair(r: np.ndarray, i: np.ndarray, j: np.ndarray, inside: np.ndarray) -> np.ndarray:
            j = np.where(inside, j, 0)
            where, ok = self._pairs(ids[r, i], ids[r, j])
            return np.where(ok & inside, self.rank[where] * leaves + i, _NONE)

        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            i = tree[live, 1] % leaves
            j = after[live, i]
            where, _ = self._pairs(ids[live, i], ids[live, j])
            ids[live, i] = self.made[where]
            ids[live, j] = -1
            nxt = after[live, j]
            after[live, i] = nxt
            inside = nxt < n[live]
            before[live[inside], nxt[inside]] = i[inside]
            put(live, j, np.full(len(live), _NONE))
            put(live, i, pair(live, i, nxt, inside))
            prev = before[live, i]
            got = prev >= 0
            if got.any():
                r, h = live[got], prev[got]
                put(r, h, pair(r, h, i[got], np.ones(len(r), bool)))
            live = live[tree[live, 1] != _NONE]
        keep = ids >= 0
        flat = ids[keep].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]) * 4
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """For each non-empty word its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(max(1, (len(w) - 1).bit_length()), []).append(k)
        for bits, members in by_size.items():
            if len(members) < _ROWS or 1 << bits > _WIDE:
                for k in members:
                    out[k] = np.array(self._one(words[k]), "<u4").tobytes()
                continue
            for a in range(0, len(members), 20_000):
                part = members[a : a + 20_000]
                for k, ids in zip(part, self._many([words[k] for k in part], 1 << bits)):
                    out[k] = ids
        return out

    # -- texts ------------------------------------------------------------------

    def _slow(self, text: str) -> bytes:
        """A text with unusual characters: the library normalises and splits it, the trees merge."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part))
                words = [bytes(map(self.byte_of.__getitem__, p)) for p, _ in pieces]
                out += self.encode_words(words)
        return b"".join(out)

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """ids of chunks that neither generation of the cache has."""
        words, ends = [], []
        for c in chunks:
            words += [c.encode()] if c.isalpha() else [w.encode() for w in self.split.findall(c)]
            ends.append(len(words))
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, self.encode_words(distinct)))
        out, start = {}, 0
        for c, end in zip(chunks, ends):
            out[c] = ids[words[start]] if end == start + 1 else b"".join([ids[w] for w in words[start:end]])
            start = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        group, weight = [], 0
        for k, text in enumerate(texts):
            if self.unusual.search(text) or "<|" in text:
                out[k] = self._slow(text)
                continue
            group.append(k)
            weight += len(text)
            if weight > 1 << 20:
                self._encode_group(texts, group, out)
                group, weight = [], 0
        self._encode_group(texts, group, out)
        return out

    def _encode_group(self, texts: list[str], group: list[int], out: list) -> None:
        parts = [texts[k].lower().split() for k in group]
        found = [list(map(self.chunks.get, p)) for p in parts]
        gaps: list[list[int]] = []  # the places in each text of chunks not known
        new: set[str] = set()
        for p, f in zip(parts, found):
            own = [i for i, ids in enumerate(f) if ids is None]
            new.update([p[i] for i in own])
            gaps.append(own)
        if new:
            add = {c: ids for c in new if (ids := self.older.get(c)) is not None}
            add |= self._learn([c for c in new if c not in add])
        for k, p, f, own in zip(group, parts, found, gaps):
            for i in own:
                f[i] = add[p[i]]
            out[k] = b"".join(f)
        if new:
            self.chunks |= add
            if len(self.chunks) > CACHE_CHUNKS:
                self.chunks, self.older = {}, self.chunks

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids: their tokens with a space between, special ones too."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """The worker's model of a vocabulary, with its cache of chunks."""
    model = Bpe(path)

    def let_go() -> None:
        model.chunks, model.older = {}, {}

    KEPT["bpe " + path] = let_go
    return model


def map_encoded(docs: DataFrame, path: str, each, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """each(id, ids as bytes, Bpe) -> rows of schema, for every text of docs (null: empty)."""

    def run(batches):
        model, kinds = bpe(path), _arrow(schema)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20, keeps="bpe " + path):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [r for i, ids in zip(part.column(0).to_pylist(), model.encode(texts)) for r in each(i, ids, model)]
                yield pa.RecordBatch.from_pydict({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds, zip(*rows))})

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, schema)


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(",")]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every row of docs. Null and empty texts: no ids."""
    return map_encoded(docs, path, lambda i, ids, _: [(i, ids)], "doc_id long, ids binary", id_col, text_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs.

    Null and empty texts have no ids and decode to the empty text. Null and
    repeated ids are kept as they are; other columns are ignored.
    """

    def each(i, ids, model):
        return [(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest())]

    return map_encoded(docs, path, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
