"""BPE encoding by speculation and verification, and decoding.

Words (pre-tokens) are encoded once per distinct word.  For the distinct words
of a batch, greedy longest match proposes tokens; one vectorised check then
tests every distinct adjacent pair of the batch.  A sequence of reachable
tokens is the exact BPE result if and only if every adjacent pair is: merging
is local, so a merge across a boundary is decided by its two neighbours alone.
Only words with a failing pair undergo exact merging (linked list and heap).

The vocabulary file is read on the driver (its path is a parameter) and sent to
the executors as one broadcast of a size fixed by the file.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Words remembered between batches; beyond it the memory is emptied, which costs time only.
REMEMBERED = 300_000
NONE = np.iinfo(np.int64).max
#: The pattern and white space of the pre-tokenizer (fixed values of the file's format).
SPACE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+")
#: The same for texts of Latin-1 only: their letters and numbers are few enough to list.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^" + "\t-\r \x85\xa0" + "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
BEYOND = re.compile("[^\x00-\xff]")


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself if printable, else the next free letter from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class IntMap:
    """Hash map from non-negative integers to integers with vectorised lookup (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.default = default
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, default, dtype=np.int64)
        for key, value, at in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.default)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


#: Words of more bytes than this are handled one at a time.
WIDE = 64


class WordBpe:
    """Tables of a word-end BPE file, and the encoder over them."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        size = max(self.token) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        keys, ranks = np.empty(len(pairs), dtype=np.int64), np.arange(len(pairs))
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (x, y) in enumerate(pairs):
            a, b, t = self.vocab[x], self.vocab[y], self.vocab[x + y]
            keys[r] = a << 32 | b
            self.merge.setdefault((a, b), (r, t))
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a, b
        first = np.unique(keys, return_index=True)[1]
        self.ranks = IntMap(keys[first], ranks[first], NONE)
        self.made = np.array([self.vocab[x + y] for x, y in pairs], dtype=np.int64)
        self.letters = byte_letters()
        special = set(self.added.values())
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for s, t in self.vocab.items():
            if t not in special:
                body = s.removesuffix(self.end)
                if body and (own := self._merged(self._symbols(body, s != body))) == [t]:
                    (self.final if s != body else self.inner)[body] = own[0]
        self._grow_trie()
        self.plain = np.array([self.vocab[c] for c in self.letters])
        self.closing = np.array([self.vocab[c + self.end] for c in self.letters])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        """Start the word memory anew: the number of each word, and its ids as a span of a pool."""
        self.known: dict[str, int] = {}
        self.pool = np.empty(0, dtype=np.int32)
        self.start = np.empty(0, dtype=np.int64)
        self.length = np.empty(0, dtype=np.int64)
        self._remember(list(self.added), np.array(list(self.added.values()), dtype=np.int64), np.ones(len(self.added), dtype=np.int64))

    def _remember(self, words: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.pool = np.concatenate([self.pool, flat.astype(np.int32)])

    def _grow_trie(self) -> None:
        """Reachable tokens by their bytes: a node's token inside a word, and at its end (-1: none)."""
        value = {c: b for b, c in enumerate(self.letters)}
        step: dict[int, int] = {}
        inner, final = [-1], [-1]
        for tokens, accept in ((self.inner, inner), (self.final, final)):
            for body, t in tokens.items():
                node = 0
                for c in body:
                    key = node << 8 | value[c]
                    if key not in step:
                        step[key] = len(inner)
                        inner.append(-1)
                        final.append(-1)
                    node = step[key]
                accept[node] = t
        self.trie = IntMap(np.array(list(step), dtype=np.int64), np.array(list(step.values()), dtype=np.int64), -1)
        self.accept = np.array(inner, dtype=np.int64), np.array(final, dtype=np.int64)

    def _symbols(self, body: str, closed: bool = True) -> list[int]:
        ids = [self.vocab[c] for c in (body[:-1] if closed else body)]
        return [*ids, self.vocab[body[-1] + self.end]] if closed else ids

    def _merged(self, ids: list[int]) -> list[int]:
        """Exact merging: the best-ranked, leftmost pair first."""
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, i) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heap = [(r, i, t, ids[i], ids[i + 1]) for r, t, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, t, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = t, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merge.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def propose(self, blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words in step: (word, token) of every proposal, in order of words.

        Every word walks the trie from the start of its next token, remembers
        the last token passed, and falls back to it where the walk ends.  A
        byte is a token, so there always is one.
        """
        inner, final = self.accept
        word = np.arange(len(start))
        at, end = start.copy(), start + size
        node, token, after = np.zeros(len(start), dtype=np.int64), np.full(len(start), -1), start.copy()
        words, tokens = [], []
        while len(word):
            inside = at < end
            node = np.where(inside, self.trie.get(node << 8 | blob[np.minimum(at, len(blob) - 1)]), -1)
            on = node >= 0
            at = at + on
            here = np.where(on, np.where(at == end, final[node], inner[node]), -1)
            token, after = np.where(here >= 0, here, token), np.where(here >= 0, at, after)
            stop = ~on
            words.append(word[stop])
            tokens.append(token[stop])
            at, node, token = np.where(stop, after, at), np.where(stop, 0, node), np.where(stop, -1, token)
            live = ~stop | (at < end)
            word, at, end, node, token, after = word[live], at[live], end[live], node[live], token[live], after[live]
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def merge_all(self, ids: np.ndarray) -> np.ndarray:
        """Exact merging of many words at once; a row is a word, padded with -1."""
        ids = ids.copy()
        n, width = ids.shape
        if width < 2:
            return ids
        rank = np.where((ids[:, :-1] >= 0) & (ids[:, 1:] >= 0), self.ranks.get(np.maximum(ids[:, :-1], 0).ravel() << 32 | np.maximum(ids[:, 1:], 0).ravel()).reshape(n, width - 1), NONE)
        rank = np.concatenate([rank, np.full((n, 1), NONE)], axis=1)
        rows, columns = np.arange(n), np.arange(width)
        while len(rows):
            j = rank[rows].argmin(axis=1)
            best = rank[rows, j]
            rows, j, best = rows[best < NONE], j[best < NONE], best[best < NONE]
            if not len(rows):
                break
            move = np.minimum(columns[None, :] + (columns[None, :] > j[:, None]), width - 1)
            x, r = np.take_along_axis(ids[rows], move, axis=1), np.take_along_axis(rank[rows], move, axis=1)
            x[:, -1], r[:, -1] = -1, NONE
            k = np.arange(len(rows))
            x[k, j] = self.made[best]
            for left in (j - 1, j):
                ok = (left >= 0) & (left + 1 < width)
                a, b = x[k, np.maximum(left, 0)], x[k, np.minimum(left + 1, width - 1)]
                ok &= b >= 0
                r[k[left >= 0], left[left >= 0]] = NONE
                r[k[ok], left[ok]] = self.ranks.get(a[ok] << 32 | b[ok])
            ids[rows], rank[rows] = x, r
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each pair of reachable tokens apart.

        The merges that formed the two are undone from the last to the first.
        Between two undone merges the tokens that face each other could have
        merged instead; that happens if their merge ranks before the merge
        undone last.  Equal ranks go to the leftmost pair, that is to the
        facing pair when the right token's merge is undone and to the left
        token's own merge otherwise.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NONE)
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            broken = self.ranks.get(x << 32 | y) < limit[live]
            good[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~broken & ((rx >= 0) | (ry >= 0))]
        return good

    def learn(self, words: set[str]) -> int:
        """Encode unknown words; returns how many needed exact merging."""
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        known = self.known
        fresh = [w for w in words if w not in known]
        if not fresh:
            return 0
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        blob = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        word, token = self.propose(blob, start, size)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, where = np.unique(token[inside] << 32 | token[inside + 1], return_inverse=True)
        failing = np.zeros(len(fresh), dtype=bool)
        failing[word[inside[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[where]]]] = True
        words_, tokens_ = [word[~failing[word]]], [token[~failing[word]]]
        for low, high in ((0, 8), (8, 12), (12, 18), (18, 28), (28, WIDE)):
            some = np.flatnonzero(failing & (size > low) & (size <= high))
            column = np.arange(high)[None, :]
            at = start[some][:, None] + column
            b = blob[np.minimum(at, len(blob) - 1)]
            last = (size[some] - 1)[:, None]
            ids = self.merge_all(np.where(column < last, self.plain[b], np.where(column == last, self.closing[b], -1)))
            row, col = np.nonzero(ids >= 0)
            words_.append(some[row])
            tokens_.append(ids[row, col])
        for k in np.flatnonzero(failing & (size > WIDE)):
            ids = self._merged(self._symbols("".join([self.letters[x] for x in raw[k]])))
            words_.append(np.full(len(ids), k))
            tokens_.append(np.array(ids, dtype=np.int64))
        word, token = np.concatenate(words_), np.concatenate(tokens_)
        self._remember(fresh, token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(fresh)))
        return int(failing.sum())

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; an added token in it stays whole."""
        if not (self.cut and "<" in text and self.cut.search(text)):
            return self._cut(text)
        return list(chain.from_iterable([p] if p in self.added else self._cut(p) for p in self.cut.split(text)))

    def _cut(self, text: str) -> list[str]:
        if text.isascii():
            return LATIN.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if not BEYOND.search(text):
            return LATIN.findall(text.lower())
        return PRETOKEN.findall(text.replace("\u03a3", "\u03c3").lower())  # lower() would make some sigmas final

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        cut = [self.words(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        counts = np.array([len(ws) for ws in cut], dtype=np.int64)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(counts.sum()))
        length = self.length[number]
        upto = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(upto[-1]) + np.repeat(self.start[number] - upto[:-1], length)
        ends = upto[np.cumsum(counts)]
        return self.pool[at], np.diff(ends, prepend=0)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        flat, n = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids if i in self.token])


_loaded: dict = {}


def _model(raw) -> WordBpe:
    """The tables, built once per worker process."""
    key = ("model", hash(raw.value))
    if key not in _loaded:
        _loaded[key] = WordBpe(raw.value)
    return _loaded[key]


def _source(spark: SparkSession, path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


#: Texts encoded at a time: the words of this many characters are in memory together.
SLICE_CHARS = 1_000_000


def bpe_encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) of whole texts' token ids; null texts count as empty.

    A clashing column of that name is replaced.  Rows, nulls in other columns
    and extra columns pass through unchanged.
    """
    raw = _source(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        model = _model(raw)
        flats, counts, start, held = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for k, size in enumerate(sizes):
            held += int(size)
            if held >= SLICE_CHARS or k == len(sizes) - 1:
                flat, n = model.encode_flat(texts.slice(start, k + 1 - start).to_pylist())
                flats.append(flat)
                counts.append(n)
                start, held = k + 1, 0
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(flats), pa.int32()))

    return docs.withColumn(ids, run(F.col(text)))


def _tokens(raw) -> pa.Array:
    """Token strings by id, built once per worker process."""
    key = ("tokens", hash(raw.value))
    if key not in _loaded:
        spec = json.loads(raw.value)
        named = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        _loaded[key] = pa.array([named.get(i) for i in range(max(named) + 1)], pa.string())
    return _loaded[key]


def bpe_decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with a column ``decoded``: the tokens of ``ids`` joined by spaces; null ids decode to ''.

    An id outside the vocabulary is skipped.
    """
    raw = _source(encoded.sparkSession, path)

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        table, out, start, held = _tokens(raw), [], 0, 0
        lists = pc.fill_null(lists, pa.scalar([], lists.type))
        for k, size in enumerate(pc.list_value_length(lists).to_numpy(zero_copy_only=False)):
            held += int(size)
            if held >= SLICE_CHARS or k == len(lists) - 1:
                part = lists.slice(start, k + 1 - start)
                flat = part.flatten()
                known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
                words = table.take(pc.if_else(known, flat, None))
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False))])
                if words.null_count:
                    gone = np.concatenate([[0], np.cumsum(words.is_null().to_numpy(zero_copy_only=False))])
                    offsets, words = offsets - gone[offsets], words.drop_null()
                out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " "))
                start, held = k + 1, 0
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return encoded.withColumn(text, run(F.col(ids)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_decode(bpe_encode(docs).drop("text"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
