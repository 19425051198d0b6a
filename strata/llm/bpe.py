r"""BPE encoding and decoding with a segment tree over pair ranks.

A word's adjacent pairs are the leaves of a segment tree that holds (merge rank, position) and keeps the minimum, so the root is
the leftmost pair of lowest rank. A merge changes three leaves (the pair itself, its left neighbour, and the swallowed symbol),
each update walks one path to the root, and the word is done when the root is empty. Words of like length share one
array of trees, a row each, so a batch's new words are merged together by NumPy.

Texts are split at white space, which no token crosses; the encoding of a chunk is kept in a dictionary per worker, whose size is
bounded. Handled is the family of the "word_bpe" file: NFC, white space, lower case, the split pattern, byte-level symbols, a word-end
suffix, special tokens found in the raw text; other settings in a tokenizer file are refused; code
points newer than the Unicode tables of this Python may be split otherwise. Decoding joins the tokens of the
ids by one space, as a tokenizer file without a decoder does. Lone surrogates cannot occur in a Spark string.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows and null ids are encoded like any row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.base import query, sha256, table, texts

#: Chunks a worker keeps; about 100 MB.
CACHE_CHUNKS = 200_000
#: Longest words are merged in groups of at most so many tree cells.
TREE_CELLS = 1 << 21

_EMPTY = np.int64(1) << 62
# White space of the file's \s, and the characters str.split() splits at beyond it.
_SPACE = re.compile("[\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """One tokenizer file: chunks in, ids out."""

    def __init__(self, definition: str, cache_chunks: int = CACHE_CHUNKS):
        spec = json.loads(definition)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]
                or level["add_prefix_space"] or level["use_regex"] or model.get("byte_fallback") or model.get("ignore_merges")
                or model.get("dropout") or model.get("continuing_subword_prefix") or spec["decoder"] is not None):
            raise ValueError("tokenizer file with settings that are not supported")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        vocab: dict[str, int] = model["vocab"]
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols, suffix = byte_symbols(), model["end_of_word_suffix"] or ""
        self.byte_ids = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last_ids = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = np.int64(len(self.tokens))
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.decimal = list(map(str, range(len(self.tokens))))
        self.cache: dict = {}
        self.cache_chunks = cache_chunks

    # -- segment trees --------------------------------------------------------------------------------------------

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """rank * size + position of each pair, or empty where the pair has no merge."""
        key = left * self.base + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[i] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[i] * size + at, _EMPTY)

    def _merge_all(self, symbols: np.ndarray) -> np.ndarray:
        """Merge each row of `symbols` (padded by -1 to a power of two) until its root is empty; gone symbols become -1."""
        n, size = symbols.shape
        out = symbols.copy()
        tree = np.full((n, 2 * size), _EMPTY, dtype=np.int64)
        place = np.arange(size)
        tree[:, size:2 * size - 1] = self._leaf(symbols[:, :-1], symbols[:, 1:], place[:-1], size)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        # neighbours; column `size` is the end mark and takes writes that fall off either side
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        before[:, 0] = size
        before = np.concatenate([before, np.full((n, 1), size)], axis=1)
        live = np.concatenate([out, np.full((n, 1), -1)], axis=1)
        rows = np.arange(n)
        while True:
            root = tree[:, 1]
            open_ = root < _EMPTY
            if not open_.all():
                out[rows[~open_]] = live[~open_, :size]
                if not open_.any():
                    return out
                tree, after, before, live, rows = tree[open_], after[open_], before[open_], live[open_], rows[open_]
                root = tree[:, 1]
            r = np.arange(len(rows))
            rank, at = root // size, root % size
            gone = after[r, at]
            nxt = np.minimum(after[r, gone], size)
            prev = before[r, at]
            new = self.merged[rank]
            live[r, at] = new
            live[r, gone] = -1
            after[r, at] = nxt
            before[r, nxt] = at
            live[:, size] = -1
            own = self._leaf(new, live[r, nxt], at, size)
            left = self._leaf(live[r, prev], new, prev, size)
            for leaf, value, there in ((gone, np.full(len(r), _EMPTY), gone < size), (at, own, None), (prev, left, prev < size)):
                node = leaf + size
                if there is not None and not there.all():
                    rr, node, value = r[there], node[there], value[there]
                else:
                    rr = r
                tree[rr, node] = value
                while len(rr) and node[0] > 1:
                    node = node >> 1
                    tree[rr, node] = np.minimum(tree[rr, 2 * node], tree[rr, 2 * node + 1])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' token ids in a row, and how many each word has; a word is given as its UTF-8 bytes."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        classes = np.ceil(np.log2(np.maximum(lengths, 2))).astype(int)
        counts, done = np.zeros(len(words), dtype=np.int64), []
        for c in np.unique(classes):
            size, chosen = 1 << int(c), np.flatnonzero((classes == c) & (lengths > 0))
            step = max(1, TREE_CELLS // size)
            for s in range(0, len(chosen), step):
                group = chosen[s:s + step]
                size_of = lengths[group]
                flat = np.frombuffer(b"".join([words[i] for i in group.tolist()]), dtype=np.uint8)
                row = np.repeat(np.arange(len(group)), size_of)
                col = np.arange(len(flat)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
                symbols = np.full((len(group), size), -1, dtype=np.int64)
                symbols[row, col] = np.where(col == size_of[row] - 1, self.last_ids[flat], self.byte_ids[flat])
                merged = self._merge_all(symbols)
                keep = merged >= 0
                counts[group] = keep.sum(axis=1)
                done.append((group, merged[keep]))
        starts = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), dtype=np.int64)
        for group, found in done:
            n = counts[group]
            ids[np.repeat(starts[group] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
        return ids, counts

    # -- texts ----------------------------------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """The lower-cased pieces between white space; special tokens stand alone, behind a space, which no plain piece holds."""
        if self.marks is not None and "<|" in text and self.marks.search(text):
            out: list[str] = []
            for piece in self.marks.split(text):
                out += [" " + piece] if piece in self.special else self._plain(piece)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: characters are lower-cased one by one
        text = text.lower()
        if _NOT_SPACE.search(text):
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def _ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All chunks' token ids in a row, and how many each chunk has."""
        words, n_words = [], []
        for c in chunks:
            if c.isascii() and c.isalpha():
                words.append(c.encode())
                n_words.append(1)
            else:
                parts = self.words.findall(c)
                words += [w.encode() for w in parts]
                n_words.append(len(parts))
        ids, counts = self.encode_words(words)
        ends = np.cumsum(np.r_[0, counts])[np.cumsum(np.r_[0, n_words])]
        return ids, np.diff(ends)

    def learn(self, chunks: Iterable[str]) -> None:
        """Encode the chunks that are not in the cache."""
        new = [c for c in chunks if c not in self.cache]
        plain = [c for c in new if c[0] != " "]
        for c in set(new) - set(plain):
            self.cache[c] = self._entry(np.array([self.special[c[1:]]]))[0]
        if plain:
            ids, counts = self._ids_of(plain)
            self.cache.update(zip(plain, self._entry(ids, counts)))

    def _entry(self, ids: np.ndarray, counts: Iterable[int] | None = None) -> list:
        """What the cache keeps of each chunk: (ids as 32-bit integers, ids as text, tokens as text)."""
        raw, listed = ids.astype("<u4").tobytes(), ids.tolist()
        decimal, tokens = list(map(self.decimal.__getitem__, listed)), list(map(self.tokens.__getitem__, listed))
        out, a = [], 0
        for n in [len(listed)] if counts is None else counts.tolist():
            b = a + n
            out.append((raw[4 * a:4 * b], " ".join(decimal[a:b]), " ".join(tokens[a:b])))
            a = b
        return out

    def encoded(self, batch: list[str]) -> Iterator[list]:
        """For each text, what the cache keeps of its chunks."""
        block, weight = [], 0
        for text in [*batch, None]:
            if text is not None:
                block.append(self.chunks(text))
                weight += len(block[-1])
            if block and (text is None or weight > 200_000):
                distinct = set().union(*block)
                self.learn(distinct)
                get = self.cache.__getitem__
                for chunks in block:
                    yield list(map(get, chunks))
                if len(self.cache) > self.cache_chunks:  # what the last block used stays
                    self.cache = {c: self.cache[c] for c in distinct}
                block, weight = [], 0

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(e[0] for e in next(self.encoded([text]))), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


class IdsOnly(Bpe):
    """Keeps only the ids of each chunk, as 32-bit integers, and so more chunks in the same memory."""

    def __init__(self, definition: str, cache_chunks: int = 2 * CACHE_CHUNKS):
        super().__init__(definition, cache_chunks)

    def _entry(self, ids: np.ndarray, counts: Iterable[int] | None = None) -> list:
        raw = ids.astype("<u4").tobytes()
        if counts is None:
            return [raw]
        ends = (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


_LOADED: dict[tuple[type, str], Bpe] = {}


def loaded(definition: str, kind: type[Bpe] = Bpe) -> Bpe:
    """One tokenizer per worker process and file."""
    name = (kind, sha256(definition))
    if name not in _LOADED:
        _LOADED.clear()
        gc.set_threshold(200_000)  # the cache's many small tuples hold no cycles
        _LOADED[name] = kind(definition)
    return _LOADED[name]


def definition_of(path: str) -> str:
    """The driver reads the file; executors get its text as a broadcast of a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for rows of doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(definition_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            found = list(bpe.encoded(batch.column(1).to_pylist()))
            ids = [np.frombuffer(b"".join(e[0] for e in f), dtype="<u4").astype(np.int32) for f in found]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate([np.empty(0, np.int32), *ids]))
            decoded = [" ".join(e[2] for e in f if e[2]) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


@query("op9_bpe")
def bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's ids and of their decoding; made beside the ids, so that these need not leave the worker."""
    shared = spark.sparkContext.broadcast(definition_of(tokenizer_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(shared.value)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for found in coder.encoded(batch.column(1).to_pylist()):
                out[0].append(sum(len(e[0]) for e in found) // 4)
                out[1].append(sha256(" ".join([e[1] for e in found if e[1]])))
                out[2].append(sha256(" ".join([e[2] for e in found if e[2]])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = texts(table(spark, sf, "documents"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
