"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct words of a slice of a partition that are not cached are laid out as one array of symbols. An index maps each
mergeable pair, by its rank, to all its positions. The lowest active rank is taken again and again: it is applied at all
its positions from left to right, each merge links the neighbours anew, and the pairs that arise are appended to the lists
of their ranks. A word's ids do not depend on what stands around it, so they are cached within bounds.

Splitting into words follows the vocabulary's own pattern. The text classes of the pattern differ between libraries for code
points that were assigned lately; a text with code points outside ``SETTLED`` is split by the tokenizer's own splitter.

Cases
-----
* null text is encoded as empty; empty text has no ids; texts are encoded whole, in slices of bounded memory
* the strings of special tokens in a text become their ids, as the tokenizer does by default
* repeated rows are each encoded; other columns are kept (``ids`` and ``decoded`` replace columns of these names)
"""

from __future__ import annotations

import gc
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_or_empty

#: Code points whose classes all Unicode versions since 10 agree on, and that cover most text.
SETTLED = regex.compile(r"[\u0000-ԧ฀-๿Ḁ-⁯₠-↋←-⏿─-⬀　-ㄭㄱ-鿪가-힣＀-￮]*+")
#: Fixed value: the pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words kept in a worker's cache, and characters of new words that one index holds.
CACHE_WORDS = 300_000
SLICE_CHARS = 150_000
#: Words of text handled at a time.
GROUP_WORDS = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings: bytes that are printable in
    Latin-1 stand for themselves, the others for the code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairIndexCodec:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.pieces = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces.update({i: s.encode() for s, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.pairs = pairs
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(pairs)}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        by_key = np.argsort(keys)
        self.keys, self.key_rank = keys[by_key], np.fromiter(self.rank.values(), np.int64, len(keys))[by_key]
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self._splitter = None

    def split(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return self.words.findall(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def _merge(self, words: list[str]) -> None:
        """Encode distinct ``words`` through one pair occurrence index, into the cache."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths + 1) - lengths  # a -1 stands before each word and at the end
        flat = np.full(int((lengths + 1).sum()) + 1, -1, np.int64)
        inside = np.ones(len(flat), bool)
        inside[starts - 1] = inside[-1] = False
        flat[inside] = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        key = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << 20 | flat[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[at] == key)
        ranks = self.key_rank[at[found]]
        by_rank = np.argsort(ranks, kind="stable")
        ranks, found = ranks[by_rank], found[by_rank]
        bounds = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist() + [len(ranks)]
        index = {int(ranks[a]): found[a:b].tolist() for a, b in zip(bounds, bounds[1:])}
        sym, after, before = flat.tolist(), list(range(1, len(flat) + 1)), list(range(-1, len(flat) - 1))
        active, rank = list(index), self.rank.get
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, merged = self.pairs[r]
            merged_left = merged << 20
            for i in sorted(index.pop(r)):
                if sym[i] != left or sym[j := after[i]] != right:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = merged, -2
                after[i] = k = after[j]
                before[k] = i
                if (x := sym[k]) >= 0 and (s := rank(merged_left | x)) is not None:
                    if s in index:
                        index[s].append(i)
                    else:
                        index[s] = [i]
                        heapq.heappush(active, s)
                h = before[i]
                if (x := sym[h]) >= 0 and (s := rank(x << 20 | merged)) is not None:
                    if s in index:
                        index[s].append(h)
                    else:
                        index[s] = [h]
                        heapq.heappush(active, s)
        out = np.array(sym, np.int64)
        live = out >= 0
        ids, counts = out[live].astype(np.int32), np.add.reduceat(live, starts) if len(starts) else []
        ends = np.cumsum(counts)
        buffer = ids.tobytes()
        for w, b, n in zip(words, (ends * 4).tolist(), (np.asarray(counts) * 4).tolist()):
            self.cache[w] = buffer[b - n : b]

    def learn(self, words: Iterable[str]) -> None:
        """Bring words into the cache, in indexes of bounded size."""
        piece, chars = [], 0
        for w in words:
            piece.append(w)
            chars += len(w)
            if chars >= SLICE_CHARS:
                self._merge(piece)
                piece, chars = [], 0
        if piece:
            self._merge(piece)

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The text's words, in runs of bounded length; a special token stands alone in its run."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield [part]
            elif part:
                words = self.split(part)
                for a in range(0, len(words), GROUP_WORDS):
                    yield words[a : a + GROUP_WORDS]

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text, int32. Runs of words of several texts share one pair index."""
        out: list[list[bytes]] = []
        waiting: list[tuple[int, list[str]]] = []
        n = 0

        def flush() -> None:
            seen = set(chain.from_iterable(run for _, run in waiting))
            if len(self.cache) + len(seen) > CACHE_WORDS:
                self.cache = {w: self.cache[w] for w in seen if w in self.cache}
            special = {s: np.int32(i).tobytes() for s, i in self.special.items()}
            self.learn([w for w in seen if w not in self.cache and w not in special])
            ids = {**self.cache, **special}.__getitem__ if special.keys() & seen else self.cache.__getitem__
            for text_no, run in waiting:
                out[text_no].append(b"".join(map(ids, run)))
            waiting.clear()

        for text_no, text in enumerate(texts):
            out.append([])
            for run in self._parts(text):
                waiting.append((text_no, run))
                n += len(run)
                if n >= GROUP_WORDS:
                    flush()
                    n = 0
        flush()
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[str, PairIndexCodec] = {}


def codec(path: str) -> PairIndexCodec:
    if path not in _codecs:
        _codecs[path] = PairIndexCodec(path)
        gc.freeze()  # the vocabulary lives as long as the worker
    return _codecs[path]


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != name), values], [*(n for n in batch.schema.names if n != name), name])


def _encoded(path: str, batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            ids = codec(path).encode_all(part.column(text).to_pylist())
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            yield _with(part, "ids", pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))


def _decoded(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            column = part.column("ids")
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            yield _with(part, "decoded", pa.array([codec(path).decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string()))


def _schema(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    names = {n for n, _ in added}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *(T.StructField(n, t) for n, t in added)])


IDS = ("ids", T.ArrayType(T.IntegerType()))
DECODED = ("decoded", T.StringType())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, the whole text's token ids."""
    docs = docs.withColumn("text", text_or_empty())
    return docs.mapInArrow(lambda batches: _encoded(path, batches, "text"), _schema(docs, IDS))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``ids`` (null: empty)."""
    return tokens.mapInArrow(lambda batches: _decoded(path, batches), _schema(tokens, DECODED))


def encode_decode(docs: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and, decoded from them, ``decoded``; one pass through Python."""
    docs = docs.withColumn("text", text_or_empty())
    schema = _schema(docs, IDS, DECODED)
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != "text"])

    def both(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _decoded(path, _encoded(path, batches, "text")):
            yield batch if keep_text else batch.select([n for n in batch.schema.names if n != "text"])

    return docs.mapInArrow(both, schema)
