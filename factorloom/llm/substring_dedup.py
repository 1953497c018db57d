"""Substring dedup by sliding sentence spans.

From every sentence a run of consecutive sentences begins: ``span`` of them, and further ones until the run has ``least_words`` words.
Every run is hashed (95 bits) and counted over all documents, and the sentences that a run covers are removed wherever it is not the run's
first occurrence, in order of doc_id and place. A sentence of ``alone_words`` words or more is a run by itself too, as a passage may hold no
second whole sentence. ``least_words=0`` and ``alone_words=None`` turn these two rules off: then runs are of ``span`` sentences, no more.

Sentences end with ``. ! ?``, their counterparts in other scripts or a line break, and are compared in lower case with white space collapsed. In
scripts without spaces two characters count as a word.

Sentences are cut and hashed in Arrow batches, a slice of texts at a time. Only repeated runs outlive the grouping; a run that a third of all documents hold is counted by partial sums and joined back
by a join whose large keys are split at run time.

Cases
-----
* null text counts as empty and stays empty; empty text has no sentences
* a null doc_id is before every other; rows with the same doc_id and text are one document here: none of them is a repeat
  of the other, and all are reported; rows with one doc_id and other texts are told apart by a 32-bit hash of the text
* texts are handled whole; columns besides doc_id and text are ignored; an empty table gives an empty report
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, text_or_empty

#: A sentence with the marks and white space that follow it; the sentences of a text joined are the text.
END = ".!?\n\u3002\uff01\uff1f\u061f\u0964"
SENTENCE = rf"[^{END}]*[{END}]+[\x20\x09-\x0D]*|[^{END}]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Characters of scripts without spaces: Thai to Tibetan, Myanmar, Khmer, Kana, Han.
UNSPACED = "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]"
SPAN, LEAST_WORDS, ALONE_WORDS = 2, 20, 20
#: Texts handled at a time.
SLICE = 200

_SENTENCE, _UNSPACED = re.compile(SENTENCE), re.compile(UNSPACED)
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def sentences(text: str) -> list[str]:
    return _SENTENCE.findall(text)


def _hashed(text: str) -> tuple[list[bytes], list[int]]:
    """128-bit hash and number of words of each sentence."""
    low = text.lower()
    unspaced = _UNSPACED.search(low) is not None
    hashes, sizes = [], []
    for s in sentences(low):
        words = s.encode().split()  # at ASCII white space
        hashes.append(xxhash.xxh3_128_digest(b" ".join(words)))
        sizes.append(len(words) + (len(_UNSPACED.findall(s)) // 2 if unspaced else 0))
    return hashes, sizes


def _combined(hashes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for each run of ``n`` sentences, order-sensitive."""
    out = n.astype(np.uint64)
    on = np.arange(len(n))
    k = 0
    while len(on):
        x = (out[on] ^ hashes[start[on] + k]) * _GOLD
        out[on] = (x ^ (x >> np.uint64(29))) * _ODD
        k += 1
        on = on[n[on] > k]
    return out ^ (out >> np.uint64(32))


def runs_of(texts: list[str], span: int, least_words: int, alone_words: int | None) -> tuple[np.ndarray, ...]:
    """``text, at, n, h1, h2`` of the runs of each text: which text, first sentence, number of sentences, hashes."""
    cut = [_hashed(t) for t in texts]
    count = np.fromiter((len(x[1]) for x in cut), np.int64, len(cut))
    if not count.sum():
        return (np.zeros(0, np.int64),) * 5
    raw = np.frombuffer(b"".join(h for x in cut for h in x[0]), np.uint64).reshape(-1, 2)
    words = np.fromiter((w for x in cut for w in x[1]), np.int64, len(raw))
    text = np.repeat(np.arange(len(cut)), count)
    first, last = (np.cumsum(count) - count)[text], np.cumsum(count)[text]
    here, total = np.arange(len(raw)), np.cumsum(words)
    # the sentence with which the words from here on are enough
    n = np.maximum(np.searchsorted(total, total - words + least_words) - here + 1, span)
    grown = np.flatnonzero(here + n <= last)
    start, n = here[grown], n[grown]
    if alone_words is not None:
        alone = np.flatnonzero(words >= alone_words)
        start, n = np.concatenate([start, alone]), np.concatenate([n, np.ones(len(alone), np.int64)])
    h1 = _combined(raw[:, 0], start, n).view(np.int64)
    h2 = _combined(raw[:, 1], start, n).view(np.int64) & 0x7FFFFFFF
    return text[start], start - first[start], n, h1, h2


def _run_rows(options: tuple, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            text, at, n, h1, h2 = runs_of(part.column("text").to_pylist(), *options)
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2.astype(np.int32)), part.column("doc_id").take(row), part.column("t").take(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["h1", "h2", "doc_id", "t", "at", "n"],
            )


def _left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences removed."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            sizes, texts, removed = [], [], [r or [] for r in part.column("removed").to_pylist()]
            for text, gone in zip(part.column("text").to_pylist(), removed):
                parts = sentences(text)
                sizes.append(len(parts))
                for k in gone:
                    parts[k] = ""
                texts.append("".join(parts) if gone else text)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(texts, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "removed", "text"],
            )


def remove_repeats(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS, alone_words: int | None = ALONE_WORDS) -> DataFrame:
    """``doc_id, n_sentences, n_removed, removed, text``: of each row the numbers of the sentences removed (from 0) and what is left."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    base = docs.select(doc_id, text_or_empty().alias("text")).withColumn("t", F.hash("text"))

    options = (span, least_words, alone_words)
    runs = stage(base.mapInArrow(lambda b: _run_rows(options, b), "h1 long, h2 int, doc_id long, t int, at int, n int"), "spans")
    place = F.struct("doc_id", "t", "at")
    # staged: then the join back is between two tables dealt by hash, and splits a run that very many documents hold
    repeated = runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first IS DISTINCT FROM last")
    repeated = stage(repeated.select("h1", "h2", "first"), "spans-repeated")
    again = runs.hint("merge").join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = again.select("doc_id", "t", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at"))
    removed = covered.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("at")).alias("removed"))  # at most one document's sentences
    removed = stage(removed, "spans-removed")
    discard(runs, repeated)

    absent = F.lit(-(2**63))
    keys = {"__id": F.coalesce("doc_id", absent), "__no_id": F.col("doc_id").isNull()}
    removed = removed.withColumns(keys).drop("doc_id")
    out = base.withColumns(keys).hint("merge").join(removed, ["__id", "__no_id", "t"], "left").select("doc_id", "text", "removed")
    return out.mapInArrow(_left, "doc_id long, n_sentences long, n_removed long, removed array<int>, text string")
