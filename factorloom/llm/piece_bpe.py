"""SentencePiece merge-type encoding and decoding by a prefix table.

Encoding takes no merge steps over the text. For each prefix of a unit of text the table holds the one piece that the prefix's
encoding ends with. An automaton over all pieces names those that end at a place; a piece is the last one exactly where it is
compatible with the last piece of what stands before it, that is, where the two pieces' joined text encodes to these two. The ids
are then recovered backwards from the end, each piece leading to the prefix before it.

A text is escaped (a space mark before it and for each space in it) and cut into units where no piece can reach across: before a
run of space marks, and around characters that no piece of two or more characters has. A unit's ids do not depend on what
stands around it, so those of short units are cached within bounds. A text is first cut at its space marks alone, since most
words are one unit; only words that the cache lacks are looked at further. Characters outside the vocabulary become byte pieces.

Compatible pairs are found by merging the pair's own characters, of which there are few, and are kept within bounds as well. The
rule needs a vocabulary in which the two-piece test decides; ``PieceCodec`` covers merge-type models with
byte fallback, a dummy prefix and no normalisation, and refuses others.

Cases
-----
* null text is encoded as empty; an empty text has the end id alone; texts are encoded whole, in slices of bounded memory
* strings such as ``</s>`` or ``<0x41>`` and the space mark in a text are ordinary characters (the mark is decoded as a space)
* an id list that is null decodes to an empty text; bytes that are no UTF-8 become one U+FFFD each
* repeated rows are each encoded; other columns are kept (``ids`` and ``decoded`` replace columns of these names)
"""

from __future__ import annotations

import codecs
import gc
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import DECODED, IDS, _schema, _with
from .common import text_or_empty

MARK = "▁"
#: Units (half of them new, half those before) and pairs kept by a worker, and the longest unit that is kept.
CACHE_UNITS = 600_000
CACHE_PAIRS = 300_000
CACHED_LENGTH = 40
#: Words or units of text handled at a time.
GROUP_UNITS = 200_000
#: Rows handled at a time.
SLICE_ROWS = 500
#: Runs of space marks with what follows them.
WORDS = re.compile(f"{MARK}+[^{MARK}]*+")


def _groups(pattern: re.Pattern, text: str) -> Iterator[list[str]]:
    """All matches in ``text``, ``GROUP_UNITS`` at a time."""
    found = map(itemgetter(0), pattern.finditer(text))
    while run := list(islice(found, GROUP_UNITS)):
        yield run


def _one_each(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("factorloom-one-each", _one_each)


class PieceCodec:
    """Encoder and decoder for a merge-type SentencePiece model; ``end`` appends the model's end id."""

    def __init__(self, path: str, end: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # reads the vocabulary; it encodes nothing here
        ids = range(model.vocab_size())
        self.end = [model.eos_id()] if end else []
        self.unknown = model.decode([model.unk_id()])
        own = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in own}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.byte) != 256 or any(MARK in p.strip(MARK) for p in self.id):
            raise ValueError("needs a model with byte fallback, whose pieces have space marks at their beginning alone")
        self.raw = {model.unk_id(): self.unknown.encode()} | {i: p.replace(MARK, " ").encode() for i, p in self.piece.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.length = [len(self.piece.get(i, "")) for i in ids]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        merging = sorted({c for p in self.id if len(p) > 1 for c in p} - {MARK})
        inside = "".join(map(re.escape, merging))
        self.units = re.compile(f"{MARK}+[{inside}]*+|[{inside}]++|[^{inside}{MARK}]")
        self.whole = {i for i, p in self.piece.items() if self._merged(p) == [p]}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, text: str) -> list[str]:
        """The few characters of one piece or of two, merged best score first, leftmost first among equals."""
        parts, score, none = list(text), self.score.get, -math.inf
        scores = [score(a + b, none) for a, b in pairwise(parts)]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            known = self.pairs[key] = self.id.get(a + b) not in self.whole and self._merged(a + b) == [a, b]
        return known

    def _bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")]

    def table(self, unit: str) -> list[int]:
        """The last piece of each prefix of ``unit``, whose characters are all in the vocabulary: one for each length from 1."""
        last = [0] * len(unit)
        length, whole, pairs = self.length, self.whole, self.pairs
        for at, piece in self.automaton.iter(unit):
            if last[at]:
                continue  # the one last piece of this prefix is known
            before = at - length[piece]
            if before < 0:
                fits = piece in whole
            elif (fits := pairs.get(last[before] << 20 | piece)) is None:
                fits = self._compatible(last[before], piece)
            if fits:
                last[at] = piece
        return last

    def unit_ids(self, unit: str) -> list[int]:
        if len(unit) == 1:
            return [self.id[unit]] if unit in self.id else self._bytes_of(unit)
        last, length = self.table(unit), self.length
        out, at = [], len(unit) - 1
        while at >= 0:
            piece = last[at]
            out.append(piece)
            at -= length[piece]
        return out[::-1]

    def _escaped(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit, int32, from the cache or, if it is short, into it. When the cache is half full, what was not asked for since the last time goes."""
        ids = self.cache.get(unit)
        if ids is None:
            ids = self.older.get(unit) or array("i", self.unit_ids(unit)).tobytes()
            if len(unit) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE_UNITS // 2:
                    self.cache, self.older = {}, self.cache
                self.cache[unit] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word, whose units are cached, though not the word if it has several."""
        if self.units.fullmatch(word):
            return self._unit(word)
        return b"".join([b"".join(map(self._unit, run)) for run in _groups(self.units, word)])

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text, int32."""
        out, end = [], array("i", self.end).tobytes()
        for text in texts:
            cached = self.cache.get
            ids = [b"".join([cached(word) or self._word(word) for word in run]) for run in _groups(WORDS, self._escaped(text))]
            out.append(np.frombuffer(b"".join([*ids, end]), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the dummy prefix goes, control ids have no text but end a run of byte pieces, the unknown id has the model's mark."""
        listed = ids.tolist()
        raws = [*map(self.raw.get, listed), None]
        runs, start = [], 0
        while start < len(raws):
            stop = raws.index(None, start)
            runs.append(b"".join(raws[start:stop]).decode("utf-8", "factorloom-one-each"))
            start = stop + 1
        text = "".join(runs)
        shown = next((i for i in listed if i in self.raw), None)
        return text[1:] if shown in self.piece and text.startswith(" ") else text


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
        gc.freeze()  # the vocabulary lives as long as the worker
    return _codecs[path]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _encoded(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        ids = codec(path).encode_all(part.column("text").to_pylist())
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        yield _with(part, "ids", pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))


def _decoded(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        column = part.column("ids")
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        yield _with(part, "decoded", pa.array([codec(path).decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, the whole text's piece ids and the end id."""
    docs = docs.withColumn("text", text_or_empty())
    return docs.mapInArrow(lambda batches: _encoded(path, batches), _schema(docs, IDS))


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
        for batch in _decoded(path, _encoded(path, batches)):
            yield batch if keep_text else batch.select([n for n in batch.schema.names if n != "text"])

    return docs.mapInArrow(both, schema)
