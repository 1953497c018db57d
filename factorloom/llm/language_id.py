"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum, over all its
segmentations into pieces, of the product of the pieces' probabilities; a forward algorithm computes it. A text's
likelihood is the product over its words. Pieces are learned by expectation-maximisation from word counts of labelled
documents: forward-backward gives the expected count of each piece over all segmentations.

All letter pieces of the vocabulary count, and words of any length are scored whole: the forward pass holds as many states as the
longest piece has letters, and looks pieces up in runs of positions of bounded size. Many words go through it at once.

The labelled rows used for learning are a sample bounded by ``sample_per_language`` (expected rows a language), drawn by a
hash of doc_id; from a longer word it learns by parts of ``LEARN_LETTERS``. Every document is scored, whole.

Cases
-----
* ``und`` with score 0 where text is null, empty or has no letter, or where no language could be learned
* rows with null lang teach nothing; a null doc_id is not held out
* equal likelihoods: the language that sorts first; repeated rows are each scored
* an empty table gives an empty report; lang, source and doc_id never enter a prediction
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare, stage, text_or_empty

UNKNOWN = "und"
#: A letter, and a run of letters and marks.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Probability of a letter that is no piece of the vocabulary, the same for all languages.
UNSEEN = 1e-7
#: Longest part of a word that is learned from at a time: forward-backward keeps the states of all its letters.
LEARN_LETTERS = 1000
#: Words and letters that go through a lattice together, and positions for which pieces are looked up at a time.
LATTICE_WORDS, LATTICE_LETTERS, POSITIONS = 5_000, 200_000, 200_000
#: Steps after which the states are scaled anew: at least UNSEEN ** 16 is left of them.
SCALED = 16
#: Words whose scores a worker keeps from slice to slice of texts; a slice that has more is held whole.
CACHE_WORDS = 200_000
#: Broadcast limit of the model, in bytes: 8 for each piece and language. More languages than fit are refused.
MODEL_BYTES = 512 * 2**20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Lower-case letter runs among the pieces of a rank file, sorted."""
    found = set()
    with open(path, "rb") as f:
        for line in f:
            try:
                piece = base64.b64decode(line.split()[0]).decode().strip().lower()
            except UnicodeDecodeError:
                continue
            if LETTERS.fullmatch(piece):
                found.add(piece)
    return sorted(found)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Trie:
    """Prefix tree of the pieces as arrays: an open hash table from node and letter to node, looked up for many positions at once."""

    def __init__(self, pieces: list[str]):
        nodes: dict[int, int] = {}
        ends = {}
        for no, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = nodes.setdefault(node << 21 | ord(c), len(nodes) + 1)
            ends[node] = no
        self.longest = max(map(len, pieces), default=1)
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        keys, values = np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes))
        bits = max(4, (4 * len(nodes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _GOLD >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node below each node by its letter; -1 where no piece goes on so."""
        key = node << 21 | letter
        slot = self._slot(key)
        out, found = self.values[slot], self.keys[slot]
        other = np.flatnonzero((found != key) & (found >= 0))
        while len(other):
            slot[other] = slot[other] + 1 & self.mask
            out[other], again = self.values[slot[other]], self.keys[slot[other]]
            other = other[(again != key[other]) & (again >= 0)]
        return out


class Lattice:
    """All segmentations of a list of words: their pieces by place. Words are taken longest first."""

    def __init__(self, words: list[str], trie: Trie):
        self.trie, self.n = trie, len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        self.letters = np.frombuffer("".join([words[k] for k in self.order]).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.width = int(self.length[0]) if self.n else 0

    def longer(self, than: int) -> int:
        """Number of words with more letters; they come first."""
        return int(np.searchsorted(-self.length, -than, side="left"))

    def edges(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``place, letters, word, piece`` of the pieces that begin from place ``low`` to before ``high`` of their word, by place."""
        m = self.longer(low)
        count = np.minimum(self.length[:m], high) - low
        word = np.repeat(np.arange(m), count)
        place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + low
        at = self.start[word] + place
        left = self.length[word] - place
        packed = []
        # place, letters, word and piece in one integer, so that one sort orders them
        base = (place - low) << 44 | word << 18
        node = np.zeros(len(at), np.int64)
        for n in range(1, self.trie.longest + 1):
            node = self.trie.child(node, self.letters[at + (n - 1)])
            known = node >= 0
            piece = self.trie.piece[node]
            if n == 1:
                packed.append(base | n << 38 | np.where(known & (piece >= 0), piece, len(self.trie.piece)))
            else:
                is_piece = known & (piece >= 0)
                packed.append(base[is_piece] | n << 38 | piece[is_piece])
            on = np.flatnonzero(known & (left > n))
            if not len(on):
                break
            at, left, base, node = at[on], left[on], base[on], node[on]
        e = np.sort(np.concatenate(packed))
        piece = e & 0x3FFFF
        piece[piece == len(self.trie.piece)] = -1  # a letter that is no piece
        return (e >> 44) + low, e >> 38 & 0x3F, e >> 18 & 0xFFFFF, piece

    def runs(self) -> Iterator[tuple[int, int]]:
        """Places in runs for which a bounded number of pieces is looked up."""
        low = 0
        while low < self.width:
            high = low + max(1, POSITIONS // self.longer(low))
            yield low, high
            low = high

    def sweep(self, runs: Iterable[tuple], p: np.ndarray, lang: np.ndarray | None = None, states: np.ndarray | None = None) -> np.ndarray:
        """Log of the summed products over all segmentations, [word, language] in the lattice's order. ``p[piece, language]``, the unseen piece last;
        with ``lang`` each word in its own language alone; ``states[letters + word]`` takes the logs at all places."""
        k = 1 if lang is not None else p.shape[1]
        ring = self.trie.longest + 1
        a = np.zeros((ring, self.n, k))
        flat = a.reshape(ring * self.n, k)
        a[0] = 1
        shift, total = np.zeros((self.n, k)), np.zeros((self.n, k))
        offset = self.start + np.arange(self.n)
        done = 0

        def finish(i: int, m: int) -> None:
            """Place i of the words that reach it; those with more letters are the first m."""
            here = a[i % ring]
            reach = int(np.searchsorted(-self.length, -i, side="right"))
            if states is not None:
                states[offset[:reach] + i] = np.log(here[:reach, 0]) + shift[:reach, 0]
            if m < reach:
                total[m:reach] = np.log(here[m:reach]) + shift[m:reach]

        for place, letters, word, piece in runs:
            bounds = np.flatnonzero(np.diff(place, prepend=-1)).tolist() + [len(place)]
            weight = p[piece] if lang is None else p[piece, lang[word]][:, None]
            for x, y in zip(bounds, bounds[1:]):
                i = done
                m = self.longer(i)
                if i and i % SCALED == 0:
                    top = a[:, :m].max(axis=0)
                    a[:, :m] /= top
                    shift[:m] += np.log(top)
                finish(i, m)
                no = word[x:y]
                to = (letters[x:y] + i) % ring * self.n + no
                flat[to] += a[i % ring].take(no, axis=0) * weight[x:y]  # a word and length come once
                a[i % ring] = 0
                done += 1
        finish(done, 0)
        return total

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        """Log likelihood[word, language], in the order of the words given."""
        out = np.empty((self.n, p.shape[1]))
        out[self.order] = self.sweep((self.edges(*run) for run in self.runs()), p)
        return out

    def expected(self, p: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts[piece, language] over all segmentations of each word in its language, ``weight`` times."""
        lang, weight = lang[self.order], weight[self.order]
        place, letters, word, piece = (np.concatenate(x) for x in zip(*(self.edges(*run) for run in self.runs())))
        ahead, behind = np.zeros(len(self.letters) + self.n), np.zeros(len(self.letters) + self.n)
        total = self.sweep([(place, letters, word, piece)], p, lang, ahead)[:, 0]
        mirrored = self.length[word] - place - letters  # the same lattice from its end
        by = np.lexsort((word, mirrored))
        self.sweep([(mirrored[by], letters[by], word[by], piece[by])], p, lang, behind)
        offset = self.start + np.arange(self.n)
        share = np.exp(ahead[offset[word] + place] + np.log(p[piece, lang[word]]) + behind[offset[word] + mirrored] - total[word]) * weight[word]
        n = p.shape[1]
        return np.bincount(piece % len(p) * n + lang[word], share, len(p) * n).reshape(p.shape)


def _together(words: list[str]) -> Iterator[list[str]]:
    """Words in lists that go through one lattice."""
    part, letters = [], 0
    for w in words:
        if part and (len(part) >= LATTICE_WORDS or letters + len(w) > LATTICE_LETTERS):
            yield part
            part, letters = [], 0
        part.append(w)
        letters += len(w)
    if part:
        yield part


@dataclass
class Model:
    """Languages and the piece probabilities of each, the unseen piece last."""

    languages: list[str]
    pieces: list[str]
    p: np.ndarray

    def __post_init__(self) -> None:
        self.trie = Trie(self.pieces)
        self._empty()

    def _empty(self) -> None:
        self._cache: dict[str, int] = {}
        self._scores = np.zeros((1024, len(self.languages)))

    def __getstate__(self) -> tuple:
        return self.languages, self.pieces, self.p, self.trie

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.pieces, self.p, self.trie = state
        self._empty()

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """Log likelihood[word, language]."""
        return Lattice(words, self.trie).log_likelihood(self.p)

    def _keep(self, words: Iterable[str]) -> None:
        """Forget the scores of all words but these."""
        kept = [w for w in words if w in self._cache]
        self._scores[: len(kept)] = self._scores[np.fromiter((self._cache[w] for w in kept), np.int64, len(kept))]
        self._cache = dict(zip(kept, range(len(kept))))

    def _learn(self, words: list[str]) -> None:
        """Bring the scores of words that are not in the cache into it."""
        for part in _together(words):
            first = len(self._cache)
            while first + len(part) > len(self._scores):
                self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
            self._scores[first : first + len(part)] = self.log_likelihood(part)
            self._cache.update(zip(part, range(first, first + len(part))))

    def score(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        """Language and its posterior (languages equally likely before) of each text."""
        counts = [Counter(words_of(t)) for t in texts]
        if self.languages:
            seen = set().union(*counts)
            new = [w for w in seen if w not in self._cache]
            if len(self._cache) + len(new) > CACHE_WORDS:
                self._keep(seen)
            self._learn(new)
        for c in counts:
            if not c or not self.languages:
                yield UNKNOWN, 0.0
                continue
            rows = np.fromiter(map(self._cache.__getitem__, c), np.int64, len(c))
            total = np.fromiter(c.values(), np.float64, len(c)) @ self._scores[rows]
            best = int(np.argmax(total))
            yield self.languages[best], float(1 / np.exp(total - total[best]).sum())


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, w[a : a + LEARN_LETTERS]) for w in words_of(text) for a in range(0, len(w), LEARN_LETTERS))
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": pa.array(counts.values(), pa.int64())})


def learn(docs: DataFrame, vocabulary_path: str, sample_per_language: int = 1500, rounds: int = 3, smoothing: float = 0.5) -> Model:
    """Fit the model to rows of ``docs`` with non-null lang that are not held out."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), "doc_id", text_or_empty().alias("text"))
    pieces = vocabulary(vocabulary_path)
    most = MODEL_BYTES // (8 * (len(pieces) + 1))
    sizes = labelled.groupBy("lang").count().orderBy("lang").limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: their model is too large to send to every worker")
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], pieces, np.ones((len(pieces) + 1, 0)))
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(sample_per_language / r["count"]))]), F.col("lang"))
    # 52 bits of the hash: the sample stays bounded for as many rows as there may be
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 12) < share * 2.0**52
    counts = labelled.where(drawn).mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "language-words")
    no = {x: i for i, x in enumerate(languages)}
    p = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
    p[-1] = UNSEEN
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(Model(languages, pieces, p))

        def expected(batches: Iterable[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            m = model.value
            total = np.zeros_like(m.p)
            for batch in batches:
                langs = np.array([no[x] for x in batch.column("lang").to_pylist()], np.int64)
                n, at = batch.column("n").to_numpy(), 0
                for words in _together(batch.column("word").to_pylist()):
                    here = slice(at, at + len(words))
                    total += Lattice(words, m.trie).expected(m.p, langs[here], n[here])
                    at += len(words)
            piece, lang = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_pydict({"piece": piece.astype(np.int32), "lang_no": lang.astype(np.int32), "n": total[piece, lang]})

        # at most one row for each piece of the vocabulary and language comes back
        found = counts.mapInArrow(expected, "piece int, lang_no int, n double").groupBy("piece", "lang_no").agg(F.sum("n").alias("n")).toArrow()
        n = np.full((len(pieces), len(languages)), smoothing)
        n[found["piece"].to_numpy(), found["lang_no"].to_numpy()] += found["n"].to_numpy()
        p[:-1] = n / n.sum(axis=0)
        model.unpersist()
    return Model(languages, pieces, p)


def identify(docs: DataFrame, model: Model, drop_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    (scored,) = spare(docs, "scored")
    docs = docs.withColumn(scored, text_or_empty())
    if drop_text:
        docs = docs.drop("text")
    names = [n for n in docs.columns if n != scored]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(scored)
            out = [x for a in range(0, len(texts), 200) for x in shared.value.score(texts.slice(a, 200).to_pylist())]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(found, schema)


def keep_identified(docs: DataFrame, vocabulary_path: str, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with all their columns: not ``und``, score ``least_score`` or more."""
    model = learn(docs, vocabulary_path)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    found = identify(docs.select("text", row), model, drop_text=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
