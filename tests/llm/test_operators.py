"""Each corpus operator on small fixtures: brute force, and nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from factorloom.llm import bpe, common, exact_dedup, html_text, language_id, mixing, near_dedup, secrets, substring_dedup, topk, warc  # noqa: E402
from factorloom.llm.components import components  # noqa: E402
from factorloom.llm.queries import BYTE_BPE, PIECES  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, digest int, label string"
LONG = "word " * 60_000


def documents(spark, rows):
    """Rows ``(doc_id, text, lang, source)`` with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, 0, "k", 1, 2, "l") for i, t, lang, s in rows], DOCS)


def vocabulary_text(n, seed, words=("ber", "ding", "lan", "tor", "vis", "mel", "quo", "ras", "tin", "pol")):
    r = random.Random(seed)
    return " ".join("".join(r.choices(words, k=r.randint(1, 3))) for _ in range(n))


ODD = [(None, None, None, None), (1, "", "en", "a"), (2, LONG, "en", "a"), (3, "Same text.", "en", None), (3, "Same text.", "en", None), (4, "SAME text.", "fr", "b"), (5, "ßÄ same", "de", "b"), (6, "   ", "en", "a"), (7, "*** 12 ###", "en", "a")]


# ---- 8 exact dedup --------------------------------------------------------------------------------------------------


def test_exact_dedup_cases(spark):
    report = [r.asDict() for r in exact_dedup.DigestIndex.fresh(spark).add(documents(spark, ODD)).collect()]
    assert len(report) == len(ODD)
    same = [r for r in report if r["doc_id"] in (3, 4)]
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in same} == {(3, 4, 3), (4, 4, 3)}
    assert sum(r["kept"] for r in same) == 1
    empty = [r for r in report if r["doc_id"] in (None, 1)]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in empty} == {(None, 1, False), (1, 1, True)}
    assert exact_dedup.DigestIndex.fresh(spark).add(documents(spark, [])).count() == 0


def test_exact_dedup_null_ids_and_repeats(spark):
    rows = [(None, "x", None, None)] * 3 + [(9, "y", None, None)] * 2
    report = exact_dedup.DigestIndex.fresh(spark).add(documents(spark, rows)).collect()
    assert sum(r["kept"] for r in report if r["doc_id"] is None) == 1 and sum(r["kept"] for r in report if r["doc_id"] == 9) == 1
    kept = exact_dedup.keep_first(documents(spark, rows))
    assert sorted((r["doc_id"] or 0, r["text"], r["label"]) for r in kept.collect()) == [(0, "x", "l"), (9, "y", "l")]


def test_digest_index_persists_and_appends(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"{tmp_path}/index", buckets=4)
    assert index.add(documents(spark, [(1, "a", None, None), (2, "b", None, None)])).where("kept").count() == 2
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(documents(spark, [(1, "a", None, None), (7, "A", None, None), (8, "c", None, None)])).collect()}
    assert again == {1: (1, False), 7: (1, False), 8: (8, True)}
    before = index.table().count()
    index.add(documents(spark, [(8, "c", None, None)])).count()
    assert index.table().count() == before == 3
    plan = index.table().select("digest").join(index.table().select("digest").withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan or "BroadcastExchange" in plan


def test_a_batch_can_be_rerun(spark, tmp_path, monkeypatch):
    """The job dies after the append, or half way through it: rerun under its name it reports the same rows as kept."""
    index = exact_dedup.DigestIndex(spark, f"{tmp_path}/index", buckets=3)
    index.add(documents(spark, [(1, "a", None, None)]), "first")
    rows = documents(spark, [(2, "a", None, None), (3, "b", None, None), (4, "b", None, None), (None, "c", None, None), (5, "d", None, None)])
    want = {(2, 1, False), (3, 4, False), (4, 4, True), (None, None, True), (5, 5, True)}

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup.DigestIndex, "report", dies)
        with pytest.raises(RuntimeError):
            index.add(rows, "second")
    half = exact_dedup.DigestIndex(spark, f"{tmp_path}/half", buckets=3)
    half.append(exact_dedup.members_of(documents(spark, [(1, "a", None, None)])), "first")
    half.append(exact_dedup.members_of(rows.where("doc_id > 3")), "second")
    for i in (index, half):
        for _ in range(2):
            assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in i.add(rows, "second").collect()} == want
        assert i.table().count() == 4 and exact_dedup.keep_first(rows, i, "second").count() == 3
        assert exact_dedup.keep_first(rows, i, "third").count() == 0


def test_a_compacted_index_outlives_its_session(spark, tmp_path):
    path = f"{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, buckets=3)
    for k in range(3):
        index.add(documents(spark, [(k, f"text {k}", None, None)])).count()
    index.compact()
    assert index.table().count() == 3 and [n for n in common.children(spark, path)] == ["g00001-3"]
    assert not any(path in p for _, p in common._written)  # not among what the driver deletes
    os.makedirs(f"{path}/g00002-3")  # a compaction that died
    other = exact_dedup.DigestIndex(spark.newSession(), path, buckets=7)
    assert (other.generation, other.buckets, other.table().count()) == (1, 3, 3)
    assert [r["kept"] for r in other.add(documents(spark, [(9, "TEXT 1", None, None)])).collect()] == [False]
    other.compact()
    assert exact_dedup.DigestIndex(spark, path).table().count() == 3


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_dedup_in_batches(spark, batches):
    r = random.Random(1)
    rows = ODD + [(i, f"text {r.randrange(40)}", None, None) for i in range(10, 120)] + [(None, "text 1", None, None), (None, "nowhere else", None, None)]
    low = [(i, (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t, *_ in rows]
    best = {}
    for i, t in low:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    sizes = collections.Counter(t for _, t in low)
    got = exact_dedup.dedup(documents(spark, rows), batches).collect()
    want = collections.Counter((i, best[t] if best[t] >= 0 else None, sizes[t]) for i, t in low)
    assert collections.Counter((x["doc_id"], x["keep_id"], x["group_size"]) for x in got) == want
    assert sum(x["kept"] for x in got) == len(best) and all(x["doc_id"] == x["keep_id"] for x in got if x["kept"])


# ---- 10 mixing ------------------------------------------------------------------------------------------------------


def brute_mix(rows, weights=(5, 2, 1), repeats=3):
    """``taken`` of each row by one plain queue."""
    size = [len([w for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]) for _, t, _, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, free, left = {}, list(sources), sum(size)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if repeats * total[s] < level * w[s]]
        for s in over or free:
            target[s] = float(repeats * total[s]) if over else level * w[s]
            left -= target[s]
            free = [x for x in free if x != s]
    key = [hashlib.md5("|".join(x for x in ("0", None if i is None else str(i), t) if x is not None).encode()).hexdigest() for i, t, *_ in rows]
    runs = []
    for k, s in enumerate(sources):
        order = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (key[i], rows[i][0] or 0, size[i]))
        cum = 0
        for i in order:
            cum += size[i]
            runs += [((e * total[s] + cum) / target[s], k, e, key[i], i) for e in range(repeats) if size[i]]
    taken, running = [0] * len(rows), 0
    for *_, i in sorted(runs):
        running += size[i]
        if running > sum(size):
            break
        taken[i] += size[i]
    return sorted(zip([-1 if r[0] is None else r[0] for r in rows], size, taken)), target


def test_mixing_against_a_plain_queue(spark):
    r = random.Random(4)
    rows = [(i, vocabulary_text(r.randint(0, 30), i), "en", r.choice(["a"] * 6 + ["b", "c", None])) for i in range(300)] + ODD
    want, target = brute_mix(rows)
    for ranges, parts in ((4096, 3), (16, 7)):
        got = mixing.fair_queue(documents(spark, rows).repartition(parts), ranges=ranges).collect()
        assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["size"], x["taken"]) for x in got) == want
        assert {x["source"]: pytest.approx(x["target"]) for x in got} == target
    assert all(x["taken"] <= 3 * x["size"] for x in got)
    copies = mixing.mix_rows(documents(spark, rows))
    assert copies.columns == documents(spark, []).columns
    times = collections.Counter((-1 if x["doc_id"] is None else x["doc_id"]) for x in copies.collect())
    assert times == collections.Counter({i: sum(t // n for j, n, t in want if j == i and n) for i, _, t in want if t})


def test_mixture_of_equal_rows_in_two_sources(spark):
    rows = [(1, "a b c d", "en", "x"), (1, "a b c d", "en", "y")] + [(i, "some words of x " * 9, "en", "x") for i in range(2, 40)] + [(7, "one two three", "en", "y")] * 5
    queued = collections.Counter()
    for r in mixing.fair_queue(documents(spark, rows)).collect():
        queued[r["doc_id"], r["source"]] += r["epochs"]
    got = collections.Counter((r["doc_id"], r["source"]) for r in mixing.mix_rows(documents(spark, rows)).collect())
    assert got == +queued and len({queued[1, "x"], queued[1, "y"]}) == 2


def test_mixing_nothing(spark):
    assert mixing.fair_queue(documents(spark, [])).count() == 0
    empty = mixing.fair_queue(documents(spark, [(1, None, None, "a"), (2, "  ", None, "b")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in empty] == [(0, 0, 0.0)] * 2


# ---- 4 secrets ------------------------------------------------------------------------------------------------------


def brute_windows(text, c):
    """Merged windows at or above the entropy, by counting each anew."""
    spans = []
    for a in range(len(text) - c.window + 1):
        if sum(c.terms[n] for n in collections.Counter(text[a : a + c.window]).values()) <= c.limit:
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], a + c.window)
            else:
                spans.append((a, a + c.window))
    return spans


def test_incremental_entropy(spark):
    r = random.Random(2)
    c = secrets.CLASSES[1]
    texts = ["".join(r.choices(c.symbols, k=n)) + "a" * m + "".join(r.choices(c.symbols, k=n)) for n, m in [(20, 0), (25, 30), (40, 5), (10, 10)]] + ["a" * 50, "ab" * 15]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets._hot_windows(F.col("t"), c).alias("w"))
    for row in df.collect():
        assert [tuple(x) for x in row["w"]] == brute_windows(row["t"], c)


def test_secret_kinds(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = {
        1: f'é password = "hunter22" and {key} then ' + "0123456789abcdef01234567",
        2: "token: abc and secret=short1 api_key:x",
        3: "PassWD:'s3cr3t/+=' TOKEN=token=abcdef",
        4: "id 550e8400-e29b-41d4-a716-446655440000 and example" + "Ab3dEf9hIjKlMnOpQrSt",
        5: "blob Zk3v9Qw7Lp2Xs8Rt5Yb1Nc6Md4 end",
        6: None,
        7: "",
        8: "Ab3dEf9hIjKexampleMnOpQrSt0123 2024-05-01T12-30-00-000000Z",
        9: " ".join(f"token=abcdef{k}" for k in range(3000)),
    }
    got = {r["doc_id"]: r for r in secrets.scan(documents(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 1, 1)
    assert got[1]["spans"].startswith("assign:2:22,access:28:48,")
    assert got[2]["n_assign"] == 1 and got[3]["n_assign"] == 2
    assert got[4]["spans"] == "entropy_base64:51:71" and got[8]["spans"] == "" and got[5]["spans"].startswith("entropy_base64:5:")
    assert got[6]["base_sha256"] == got[7]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [tuple(map(int, x.split(":")[1:])) for x in got[9]["spans"].split(",")] == [m.span() for m in re.finditer("token=[a-z0-9]+", texts[9])]
    assert secrets.scan(documents(spark, [])).count() == 0 and secrets.scan(documents(spark, ODD)).count() == len(ODD)


# ---- 2 BPE ----------------------------------------------------------------------------------------------------------

TEXTS = ["", "<|endoftext|>a b<|endoftext|>", "ſ İ 日本語 𝒳 \U0001f600՘ x y\x1c \x85  end  ", "don't I'LL we've \n\n  x", "a" * 3000, " " * 500, "Ᲊᲊ test", "aaaaabababab", LONG, "naïve café – „quoted“ ½", "\t\r\n x﻿"]


def test_bpe_equals_the_library(spark):
    known = tokenizers.Tokenizer.from_file(BYTE_BPE)
    texts = [*TEXTS, *(vocabulary_text(40, s) for s in range(20)), None]
    df = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(3)
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, BYTE_BPE).collect()}
    for i, t in enumerate(texts):
        want = known.encode(t or "", add_special_tokens=False).ids
        assert list(got[i]["ids"]) == want and got[i]["decoded"] == known.decode(want, skip_special_tokens=False), i
        assert got[i]["label"] == "l"
    assert bpe.encode(documents(spark, []), BYTE_BPE).count() == 0


def test_bpe_decodes_any_ids(spark):
    known = tokenizers.Tokenizer.from_file(BYTE_BPE)
    r = random.Random(1)
    rows = [(i, [r.randrange(50_257) for _ in range(30)]) for i in range(30)] + [(99, [])]
    got = bpe.decode(spark.createDataFrame(rows, "i int, ids array<int>"), BYTE_BPE).collect()
    assert all(x["decoded"] == known.decode(list(x["ids"]), skip_special_tokens=False) for x in got)


def test_bpe_small_cache_and_groups(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "GROUP_WORDS", 7)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 9)
    known, own = tokenizers.Tokenizer.from_file(BYTE_BPE), bpe.PairIndexCodec(BYTE_BPE)
    texts = [vocabulary_text(30, s) for s in range(6)]
    assert [x.tolist() for x in own.encode_all(texts)] == [known.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_pairs_rank_above_what_made_them():
    """So one pass over ascending ranks is the same as always taking the lowest rank."""
    codec = bpe.codec(BYTE_BPE)
    born = {m: r for r, (_, _, m) in enumerate(codec.pairs)}
    assert all(born.get(a, -1) < r and born.get(b, -1) < r for r, (a, b, _) in enumerate(codec.pairs))


# ---- 3 language ID --------------------------------------------------------------------------------------------------


def brute_likelihood(word, model, lang):
    """Sum over all segmentations, one after another."""
    ids = {p: i for i, p in enumerate(model.pieces)}

    def p(piece):
        return model.p[ids[piece], lang] if piece in ids else (model.p[-1, lang] if len(piece) == 1 else 0.0)

    total = 0.0
    for cut in range(2 ** (len(word) - 1)):
        at, product = 0, 1.0
        for k in range(1, len(word) + 1):
            if k == len(word) or cut >> (k - 1) & 1:
                product *= p(word[at:k])
                at = k
        total += product
    return total


def toy_model():
    r = np.random.default_rng(0)
    p = r.random((6, 2)) / 10
    p[-1] = 1e-7
    return language_id.Model(["aa", "bb"], ["a", "ab", "b", "ba", "aba"], p)


def test_forward_sums_all_segmentations(monkeypatch):
    m = toy_model()
    words = ["a", "ab", "abab", "aabba", "zab", "z", "abazabbabaab"]
    want = [[brute_likelihood(w, m, k) for k in (0, 1)] for w in words]
    np.testing.assert_allclose(np.exp(m.log_likelihood(words)), want, rtol=1e-9)
    monkeypatch.setattr(language_id, "POSITIONS", 5)
    monkeypatch.setattr(language_id, "SCALED", 2)
    np.testing.assert_allclose(np.exp(m.log_likelihood(words)), want, rtol=1e-9)


def test_forward_over_long_words(monkeypatch):
    """Against a sum over one state a letter, in logarithms, beyond what a double holds."""
    m = toy_model()
    words = ["".join(random.Random(k).choices("abz", k=n)) for k, n in enumerate((900, 300, 17, 40, 1))]
    ids = {p: i for i, p in enumerate(m.pieces)}
    for w, got in zip(words, m.log_likelihood(words)):
        for lang in (0, 1):
            log = [0.0] + [-math.inf] * len(w)
            for j in range(1, len(w) + 1):
                parts = [log[j - n] + math.log(m.p[ids[w[j - n : j]], lang]) for n in (1, 2, 3) if n <= j and w[j - n : j] in ids]
                if w[j - 1] not in ids:
                    parts.append(log[j - 1] + math.log(m.p[-1, lang]))
                log[j] = max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts))
            assert got[lang] == pytest.approx(log[-1])


def test_trie_finds_every_piece():
    pieces = language_id.vocabulary(PIECES)
    assert max(map(len, pieces)) > 12 and {"absolutely", "absolument"} <= set(pieces)
    trie = language_id.Trie(pieces)
    node = np.zeros(len(pieces), np.int64)
    for k in range(trie.longest):
        on = np.array([len(p) > k for p in pieces])
        node[on] = trie.child(node[on], np.array([ord(p[k]) for p in pieces if len(p) > k]))
    assert (trie.piece[node] == np.arange(len(pieces))).all()
    assert (trie.child(np.zeros(2, np.int64), np.array([1, 2])) == -1).all()


def test_expected_counts():
    m = toy_model()
    words, lang, weight = ["abab", "ba", "zabba", "abab"], np.array([0, 0, 1, 1]), np.array([2.0, 1.0, 3.0, 1.0])
    got = language_id.Lattice(words, m.trie).expected(m.p, lang, weight)
    want = np.zeros_like(m.p)
    ids = {p: i for i, p in enumerate(m.pieces)}
    for w, k, n in zip(words, lang, weight):
        total = brute_likelihood(w, m, k)
        for cut in range(2 ** (len(w) - 1)):
            ends = [i for i in range(1, len(w)) if cut >> (i - 1) & 1] + [len(w)]
            parts = [w[a:b] for a, b in zip([0] + ends, ends)]
            if all(x in ids or len(x) == 1 for x in parts):
                chance = math.prod(m.p[ids.get(x, len(m.p) - 1), k] for x in parts)
                for x in parts:
                    want[ids.get(x, len(m.p) - 1), k] += n * chance / total
    np.testing.assert_allclose(got, want, rtol=1e-9)


LANGUAGES = {"en": ("the", "ing", "and", "th", "er"), "de": ("sch", "ung", "der", "ein", "ü"), "fr": ("eau", "ou", "le", "é", "tion")}


def test_language_id_learns_and_holds_out(spark):
    rows = [(i, vocabulary_text(25, i, LANGUAGES[lang]), lang, None) for i, lang in enumerate(list(LANGUAGES) * 60)]
    odd = [(900, None, "en", None), (901, "", None, None), (902, "123 *** ###", "en", None), (903, vocabulary_text(30, 5, LANGUAGES["de"]), None, None), (None, "the and", "en", None), (905, "ü" * 100_000, "de", None)]
    df = documents(spark, rows + odd)
    model = language_id.learn(df, PIECES)
    got = {r["doc_id"]: r for r in language_id.identify(df.select("*", language_id.held_out().alias("held_out")), model).collect()}
    assert len(got) == len(rows) + len(odd) and got[5]["label"] == "l"
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 905)] == ["und", "und", "und", "de", "de"]
    assert got[900]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in got if i is not None and __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    kept = language_id.keep_identified(df, PIECES)
    assert kept.columns == df.columns and kept.count() == len(rows) + 3


def test_language_id_small_cache(monkeypatch):
    texts = ["abab ba ab", "aba bb", "ba a b ab abba", "", "bb"]
    want = list(toy_model().score(texts))
    monkeypatch.setattr(language_id, "CACHE_WORDS", 3)
    m = toy_model()
    list(m.score(["ab bb"]))  # the cache is not empty when a slice with more words comes
    assert list(m.score(texts)) == want and [x for t in texts for x in m.score([t])] == want


def test_language_id_without_labels(spark):
    df = documents(spark, [(1, "words here", None, None)])
    model = language_id.learn(df, PIECES)
    assert [r["lang_pred"] for r in language_id.identify(df, model).collect()] == ["und"]
    assert language_id.identify(documents(spark, []), model).count() == 0


# ---- 5 near-dedup ---------------------------------------------------------------------------------------------------


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = vocabulary_text(1, r.random())
    return " ".join(words)


def brute_classes(texts):
    def profile(t):
        w = (t or "").lower().split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    p = {i: profile(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in p:
        for j in p:
            if i < j and (p[i] == p[j] or jp(p[i], p[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def jp(x, y):
    x, y = collections.Counter(x), collections.Counter(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in {*x, *y}) for i in x if i in y)


def test_similarity_is_probability_jaccard():
    r = np.random.default_rng(1)
    for _ in range(20):
        x = {int(k): int(n) for k, n in zip(r.choice(30, 12, replace=False), r.integers(1, 5, 12))}
        y = {int(k): int(n) for k, n in zip(r.choice(30, 15, replace=False), r.integers(1, 5, 15))}
        a, b = ((np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (x, y))
        assert near_dedup.similarity(a, b) == pytest.approx(jp(x, y))
        for least in (0.05, 0.2, 0.4, 0.6, 0.8):
            assert near_dedup._close(a, b, least) == (jp(x, y) >= least)
    assert near_dedup._close(a, a, 1.0) and not near_dedup._close(a, (a[0][:0], a[1][:0]), 0.0)


def test_sketch_estimates_probability_jaccard():
    r = np.random.default_rng(5)
    docs = [(np.sort(r.choice(400, 150, replace=False)).astype(np.uint64) * near_dedup._GOLD, r.integers(1, 4, 150)) for _ in range(12)]
    doc = np.repeat(np.arange(12), 150)
    registers = near_dedup.sketch(doc, np.concatenate([s for s, _ in docs]), np.concatenate([n for _, n in docs]), 12)
    errors = []
    for i in range(12):
        for j in range(i):
            order = [np.argsort(docs[k][0]) for k in (i, j)]
            exact = near_dedup.similarity((docs[i][0][order[0]], docs[i][1][order[0]]), (docs[j][0][order[1]], docs[j][1][order[1]]))
            errors.append((registers[i] == registers[j]).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.15


def test_near_duplicates_against_brute_force(spark):
    base = [vocabulary_text(150, s) for s in range(4)]
    texts = {i: edited(base[i % 4], i % 9, i) for i in range(60)}
    texts |= {100: None, 101: "", 102: "one two", 103: "one  TWO", 104: "one two three", 105: base[0] + " " + "x y z w v " * 40, 106: vocabulary_text(150, 50)}
    rows = [(i, t, None, None) for i, t in texts.items()] + [(5, texts[5], None, None)]
    got = near_dedup.near_duplicates(documents(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(texts)
    kept = near_dedup.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts).values()))


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    text = vocabulary_text(60, 1)
    got = near_dedup.near_duplicates(documents(spark, [(None, text, None, None), (8, text, None, None), (None, "alone here", None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in got if r["class_id"]) == [(0, 8), (8, 8)]
    assert near_dedup.keep_one(documents(spark, [(None, text, None, None), (8, text, None, None), (None, "alone here", None, None)])).count() == 2


def test_near_duplicates_with_repeated_ids(spark):
    one, other = vocabulary_text(60, 11), vocabulary_text(60, 12)
    rows = [(1, one, None, None), (1, other, None, None), (2, one + " more", None, None), (3, other.upper(), None, None), (1, one, None, None)]
    found = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert {r["class_id"] for r in found} == {1} and sorted(collections.Counter(r["label"] for r in found).values()) == [2, 3]
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.keep_one(documents(spark, rows)).collect()) == sorted([(1, one), (1, other)])


def test_components(spark):
    r = random.Random(3)
    links = [(f"{a:03}", f"{b:03}") for a, b in [(r.randrange(120), r.randrange(120)) for _ in range(90)]] + [("200", f"{k}") for k in range(300, 340)] + [(f"{k}", f"{k + 1}") for k in range(400, 440)]
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and set(root) - set(got) <= {a for a, b in links if a == b}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


# ---- 6 top-k --------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    v = [(i, [math.floor(float(np.float32(c)) * 1024) for c in x]) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for q, x in v:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in v if c != q and len(x) == len(y))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_top_k_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "BLOCK", 2)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8) * r.choice([0.1, 1, 4])]) for i in range(420)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, rows[0][1]), (2001, rows[0][1])]
    rows += [(3000, None), (3001, [1.0, None] + [0.0] * 6), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8), (3004, []), (3100, [1.0, 2.0]), (3101, [0.5, 0.5]), (None, [1.0] * 8), (3200, [0.0] * 8)]
    rows += [(3, rows[3][1])] * 40 + [(100, rows[100][1]), (200, rows[5][1])]
    df = spark.createDataFrame([(i, x, 1, "b") for i, x in rows], "vec_id long, embedding array<float>, bucket int, bound string")
    vectors = topk.quantised(df)
    found = topk.top_k(vectors.where("id % 100 = 0"), vectors, 10).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 10)


def test_top_k_of_nothing(spark):
    none = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == 0


# ---- 7 HTML ---------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="page has-sidebar"><header><div>Site name</div></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; tail</h1></header><p>First <b>bold</b>
 para&nbsp;graph<p>Second<script>var x="</p>";</script> one<aside>More</aside><div class="ad">Buy</div><!-- no --><ul><li>item 1<li>item 2</ul>{extra}<form><input><label>Mail</label></form>
<section id="comments"><p>Nice!</p></section></article><div class="sidebar">Side</div><footer>&copy; me</footer></body></html>"""


def test_page_structure():
    want = "Head & tail\nFirst bold para graph\nSecond one\nitem 1\nitem 2"
    assert html_text.main_text(PAGE.format(extra="")) == want
    # the prose of an article stays, even where a neighbour has the same lines; other shared lines go
    hashes = [html_text._hash(x[0]) for x in html_text.lines_of(PAGE.format(extra="<div>Read on</div><p><a href=/>All</a>"))]
    other = PAGE.format(extra="<p>Own<div>Read on</div><p><a href=/>All</a><p><a href=/x>Mine</a>")
    assert html_text.main_text(other, [hashes]) == html_text.main_text(other, [None, hashes]) == want + "\nOwn\nMine"
    assert html_text.main_text(other) == want + "\nOwn\nRead on\nAll\nMine"
    assert html_text.main_text("") == "" and html_text.main_text("plain &lt;text&gt; <b>x") == "plain <text> x"
    assert html_text.main_text("<form><main><p>in a form</main></form>") == "in a form"
    assert html_text.main_text("<p>a<script>never closed") == "a"
    assert html_text.main_text("<div class='article-body'><p>a</div></div></div><p>b") == "a"


def test_pages_without_article():
    old = "<table><tr><td class='menu'>Menu</td><td class='content'><h2>T</h2>Straight<br>text<p>More</td><td class='ads'>Ad</td></tr></table>"
    assert html_text.main_text(old) == "T\nStraight text\nMore"
    blog = "<body class='has-comments'><div id='wrapper'><div id='content'><h1>T</h1><p>A<ins class='adsbygoogle'>x</ins><p>B<span class='ad'>y<p>C</div><div id='sidebar'>S</div></div></body>"
    assert html_text.main_text(blog) == "T\nA\nB\nC"
    # without any container a neighbour's lines go, unless nothing would be left
    bare = "<div>Menu</div><p>Own</p><div>Imprint</div>"
    frame = [html_text._hash(x) for x in ("Menu", "Other", "Imprint")]
    assert html_text.main_text(bare, [frame]) == "Own"
    assert html_text.main_text(bare, [[html_text._hash(x) for x in ("Menu", "Own", "Imprint")]]) == "Menu\nOwn\nImprint"


KEPT = [
    '<p title="the hidden door">Alpha text</p>', '<a href="/hidden">Alpha text</a>', '<div data-id="related-stock">Alpha text</div>', '<div data-class="menu">Alpha text</div>',
    '<h1 id="related-work">Alpha text</h1>', '<div class="share-price">Alpha text</div>', '<div class="social-history">Alpha text</div>', '<section id="alert-systems">Alpha text</section>',
    '<section id="notice">Alpha text</section>', '<p class="teaser">Alpha text</p>', '<div class="has-sidebar">Alpha text</div>', '<div class="content-sidebar-wrap">Alpha text</div>',
    '<p>Alpha <button>Copy</button>text</p>', '<p>Alpha <span class="ad">Buy</span> text</p>', '<pre>Alpha <code><span class="comment">text</span></code></pre>', "<h2 id=share>Alpha text</h2>",
    '<div class="entry-header">Alpha text</div>', '<p style="color:red" onclick="hidden()">Alpha text</p>', '<div class="page-2 comment-free">Alpha text</div>', '<li id="menu">Alpha text',
]
GONE = [
    '<div class="ad">x</div>', '<div class="ad-slot top">x</div>', "<div class='cookie-notice'>x</div>", '<div id="sidebar-left">x</div>', '<ul class="mainMenu"><li>x</ul>', '<div class="relatedPosts">x</div>',
    '<section id="comments">x</section>', '<section class="notice">x</section>', '<div class="share-buttons">x</div>', '<div hidden>x</div>', '<div HIDDEN="">x</div>', '<p style="display: none">x</p>',
    '<div role="navigation">x</div>', '<table><tr><td class="nav">x</table>', '<div class="google-ad-300">x</div>', '<div class="social-links">x</div>', "<div class=newsletter_signup>x</div>", '<p class="ad">x</p>',
]


@pytest.mark.parametrize("html", KEPT)
def test_names_that_keep_text(html):
    assert html_text.main_text(html) == html_text.main_text(f"<article>{html}</article>") == "Alpha text"


@pytest.mark.parametrize("html", GONE)
def test_names_that_delete_text(html):
    assert html_text.main_text(f"<p>a{html}<p>b") == html_text.main_text(f"<article><p>a</p>{html}<p>b</article>") == "a\nb"


def brute_site(rows):
    """Texts of pages by plain lists: neighbours by sorting, alignment by the whole table."""
    def parts(url):
        rest = (url or "").split("://", 1)[-1] if "://" in (url or "") else ""
        host, _, path = rest.partition("/")
        path = ("/" + path).split("#")[0].split("?")[0] if path else ""
        return host.lower(), re.sub(r"(\.html?)?/*$", "", path)

    def aligned(a, b):
        best = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + (i,) if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j], key=len)
        return set(best[-1][-1])

    lines = {parts(u): html_text.lines_of(h or "") for _, u, h in rows}  # paths are not repeated in these tests
    order, out = sorted(x for x in lines if x[0]), {}
    for i, u, h in rows:
        place, own = parts(u), html_text.lines_of(h or "")
        gone = set()
        if place[0]:
            k = order.index(place)
            for n in (k - 1, k + 1):
                if 0 <= n < len(order) and order[n][0] == place[0]:
                    gone |= aligned([x[0] for x in own], [x[0] for x in lines[order[n]]])
        gone = {g for g in gone if not (own[g][1] >= html_text.MAIN and own[g][3])}
        body = [(g, x) for g, x in enumerate(own) if not x[2]]
        for c in (html_text.ARTICLE, html_text.MAIN, html_text.GUESSED):
            if any(x[1] & c for _, x in body):
                body = [(g, x) for g, x in body if x[1] & c]
                break
        out[i] = "\n".join([x[0] for g, x in body if g not in gone] or [x[0] for _, x in body])
    return out


def test_pages_against_brute_force(spark):
    """Sites with furniture that no name marks, within articles and without any."""
    r, rows = random.Random(3), []
    for i in range(120):
        own = "".join(f"<p>{vocabulary_text(8, 1000 * i + k)}</p>" for k in range(r.randrange(4)))
        common = "".join(f"<{t}>{x}</{t}>" for t, x in sorted(r.sample([("div", "Read on"), ("p", "<a href=/>All news</a>"), ("p", "A shared paragraph"), ("div", "Print")], 2)))
        frame = ["<div>Top</div>{}<div>Imprint</div>", "<article><h1>T</h1>{}</article>", "<nav>N</nav><main>{}</main><footer>F</footer>"][i % 3]
        rows.append((i, f"http://h{r.randrange(3)}.example/{'abc'[r.randrange(3)]}/{i}{r.choice(['', '.html', '?q=1', '#t'])}", frame.format(own + common)))
    rows += [(200, None, "<p>x"), (201, "http://alone.example/", None)]
    got = {x["page_id"]: x["text"] for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = brute_site(rows)
    assert got == want and sum(t != html_text.main_text(h or "") for (_, _, h), t in zip(rows, want.values())) > 60


def test_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(60):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = sorted(html_text.longest_common(a, b))
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(any(a[i] == x for x in rest) for i in got)


def test_neighbours_do_not_depend_on_partitions(spark):
    shared = "".join(f"<div>menu {k}</div>" for k in range(4))
    rows = [(i, f"http://Host{i % 2}.example/a/{i // 2:03}", f"<body>{shared}<p>own text {i}</p><div>foot</div></body>") for i in range(40)]
    rows += [(90, None, "<p>alone</p>"), (91, "odd url", None), (92, "http://host0.example/a/003#top", rows[6][2]), (93, "http://x.example/", ""), (5, *rows[5][1:])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, lines string")
    results = []
    for n in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted((r["page_id"], r["url"] or "", r["text"]) for r in html_text.extract(df.repartition(n)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] and len(results[0]) == len(rows)
    assert all(t == f"own text {i}" for i, _, t in results[0] if i < 40)
    assert html_text.extract(df.limit(0)).count() == 0


def test_every_page_of_a_path_has_a_neighbour(spark):
    frame = "<div>menu</div>{}<div>foot</div>"
    rows = [(i, f"http://h.example/index.php?id={i}", frame.format(f"<p>own text {i}</p>")) for i in range(9)]
    rows += [(90, "http://h.example/other", frame.format("<p>other</p>")), (91, "http://one.example/a?x=1", frame.format("<p>x</p>")), (92, "http://one.example/a?x=2", frame.format("<p>y</p>"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {**{i: f"own text {i}" for i in range(9)}, 90: "other", 91: "menu\nx\nfoot", 92: "menu\ny\nfoot"}


# ---- 9 substring dedup ----------------------------------------------------------------------------------------------


def sentence(n, seed):
    return vocabulary_text(n, seed).capitalize() + ". "


def test_repeated_passages_go(spark):
    passage = "".join(sentence(14, 100 + k) for k in range(4))
    alone = sentence(25, 500)
    short = "".join(sentence(1, 700 + k) for k in range(30))  # neighbouring sentences have few words
    han = "".join("".join(random.Random(k).choices("".join(map(chr, range(0x4E00, 0x4E80))), k=14)) + "\u3002" for k in range(4))
    own = {i: sentence(12, 900 + i) + sentence(9, 950 + i) for i in range(9)}
    rows = [(1, own[1] + passage + own[2]), (2, passage + own[3]), (3, own[4] + alone), (4, own[5] + alone.upper()), (5, own[6] + passage + passage), (6, None), (7, ""), (8, "Of. The. Of. The. Of. The."), (9, LONG), (1, own[1] + passage + own[2])]
    rows += [(10, own[7] + short), (11, short), (12, han), (13, han + own[8])]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    got = substring_dedup.remove_repeats(docs.repartition(4)).collect()
    text = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert [text[i] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [rows[0][1], own[3], rows[2][1], own[5], own[6], "", "", rows[7][1]] and text[9] == LONG
    assert [text[i] for i in (10, 11, 12, 13)] == [own[7] + short, "", han, own[8]]
    plain = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs, least_words=0, alone_words=None).collect()}
    assert plain[4] == own[5] + alone.upper() and plain[8] == "Of. The. " and plain[11] == ""
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


# ---- 1 WARC ---------------------------------------------------------------------------------------------------------

RECORDS = "record_id long, kind string, url string, ts long, status int, headers map<string,string>, digest string, stored string, slice int"


def record(i, kind, ts, url="http://www.A.com/x/?utm_source=q#f", status=200, digest=None, **headers):
    return (i, kind, url, ts, status, {k.replace("_", "-"): v for k, v in headers.items()} or None, digest, "s", 1)


def test_revisits(spark):
    rows = [
        record(1, "response", 10, ETag='"a"', Content_Type="text/html", Age="1"), record(2, "response", 20, url="https://a.com:443/x", ETag='"b"'), record(3, "response", 15, status=404, ETag='"z"'),
        record(10, "revisit", 15, etag='W/"a"', Content_Type="x", age="7", Server="s"), record(11, "revisit", 25, ETag='"a"'), record(12, "revisit", 20, ETag='"a"'), record(13, "revisit", 10, ETag='"a"'),
        record(14, "revisit", 30), record(15, "revisit", 30, url=None, ETag='"a"'), record(16, "revisit", 30, url="http://b.com/", ETag='"a"'), record(17, "revisit", None, ETag='"a"'), record(12, "revisit", 20, ETag='"a"'),
        record(18, "response", 40, url="http://c.com/", digest="d", Last_Modified="m"), record(19, "revisit", 41, url="http://c.com", digest="d"), record(20, "revisit", 41, url="c.com"), record(21, "revisit", 42, url="http://c.com", Last_Modified="n"),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert len(got) == 12
    by = {r["record_id"]: r for r in got}
    assert {i: (r["outcome"], r["resolved_id"]) for i, r in by.items()} == {
        10: ("resolved", 1), 11: ("mismatch", 2), 12: ("resolved", 1), 13: ("no_response", None), 14: ("no_validator", 2), 15: ("no_url", None), 16: ("no_response", None), 17: ("no_response", None),
        19: ("resolved", 18), 20: ("no_validator", 18), 21: ("mismatch", 18),
    }
    assert by[10]["headers"] == {"etag": 'W/"a"', "content-type": "text/html", "age": "7", "server": "s"} and by[19]["digest"] == "d"
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisits_against_brute_force(spark):
    r = random.Random(8)
    rows = [record(i, r.choice(["response", "revisit"]), r.randrange(60), url=r.choice(["http://h.com/hot"] * 4 + ["http://h.com/b"]), ETag=r.choice("ab")) for i in range(400)]
    got = {x["record_id"]: (x["outcome"], x["resolved_id"]) for x in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    for i, kind, url, ts, _, h, *_ in rows:
        if kind == "revisit":
            earlier = max(((x[3], x[0], x[5]["ETag"]) for x in rows if x[1] == "response" and x[2] == url and x[3] < ts), default=None)
            assert got[i] == (("no_response", None) if earlier is None else ("resolved" if earlier[2] == h["ETag"] else "mismatch", earlier[1]))


def test_canonical_urls(spark):
    urls = {"HTTP://WWW2.Example.com:80/A/b/?utm_x=1&q=2#t": "example.com/A/b?q=2", "https://example.com/": "example.com", "http://e.com/p?utm_a=1": "e.com/p", "http://e.com/p?a=1&utm_b=2&c=3": "e.com/p?a=1&&c=3"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == urls


CLASHING = "base added whole bare assign ids decoded lang_pred score scored key named each rest row copy id no_id digest label t text_id h1 parts removed Text_ KEY_".split()


def test_clashing_columns_are_kept(spark):
    """Operators that keep columns keep those whose names they use inside; docstrings name the ones that they replace."""
    rows = [(i, vocabulary_text(30, i, LANGUAGES["en"]), "en", "s", *range(len(CLASHING))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHING))
    outs = {
        "exact": exact_dedup.keep_first(docs), "near": near_dedup.keep_one(docs), "mixed": mixing.mix_rows(docs), "language": language_id.keep_identified(docs, PIECES),
        "secrets": secrets.find_secrets(docs), "bpe": bpe.encode_decode(docs, BYTE_BPE), "identify": language_id.identify(docs, language_id.learn(docs, PIECES)),
    }
    replaced = {"secrets": {"base", "added"}, "bpe": {"ids", "decoded"}, "identify": {"lang_pred", "score"}}
    for name, df in outs.items():
        assert len(set(df.columns)) == len(df.columns) and set(df.columns) == set(docs.columns), name
        for r in df.collect():
            assert all(r[c] == k for k, c in enumerate(CLASHING) if c not in replaced.get(name, ())), name
    for df in (substring_dedup.remove_repeats(docs), exact_dedup.dedup(docs), secrets.scan(docs), near_dedup.near_duplicates(docs), mixing.fair_queue(docs)):
        assert df.count() == 6


def test_scratch_is_the_named_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    assert named is None or common.scratch(spark).startswith(named.rstrip("/")[:10])
