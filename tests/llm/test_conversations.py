"""Conversation repair, the prefix trie and the piece codec: brute force, a library, and odd rows."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from factorloom.llm import conversation_repair as repair  # noqa: E402
from factorloom.llm import conversation_trie as trie  # noqa: E402
from factorloom.llm import piece_bpe  # noqa: E402
from factorloom.llm.queries import PIECE_BPE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Turns with further columns whose names the operators use inside.
TURNS = "conv_id long, turn long, role string, text string, audit string, place int, digest int, n int, depth int, block string, fp long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "b", 5) for r in rows], TURNS)


# ---- 11 conversation repair -----------------------------------------------------------------------------------------


def ordered(rows):
    """One conversation's (turn, role, text), null as one space, in the operator's order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least cost and audit, and the turns that are left, over all edits with at most two inserts in a place."""
    options = []
    for (_, role, text), fault in zip(rows, faults(rows)):
        late = fault == "truncated"
        ways = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            ways += [(late, "K", [(role, text)])] + [(2 + late, "R", [(r, text)]) for r in ("user", "assistant")]
        options.append(ways)
    inserts = [(2 * len(x), "I" * len(x), [(r, "") for r in x]) for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    steps = [inserts]
    for ways in options:
        steps += [ways, inserts]
    best = None
    for edits in itertools.product(*steps):
        left = [t for e in edits for t in e[2]]
        if all(r for r, _ in left) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left)):
            way = sum(e[0] for e in edits), "".join(e[1] for e in edits), left
            if best is None or way[:2] < best[:2]:
                best = way
    return best


def in_turn(rows):
    """The same by the best way to each state, turn after turn; for long conversations."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def with_inserts(best):
        for _ in range(2):
            for (i, _), j in [(k, v) for k, v in step.items() if k[1] in "ua"]:
                if i in best:
                    way = best[i][0] + 2, best[i][1] + "I"
                    best[j] = min(best.get(j, way), way)
        return best

    best = with_inserts({0: (0, "")})
    for (_, role, _), fault in zip(rows, faults(rows)):
        late, new = fault == "truncated", {}
        for i, (c, a) in best.items():
            ways = [(i, 3, "D")]
            if fault not in ("blank", "duplicate"):
                ways += [(step[i, role[:1]], late, "K")] if (i, role[:1]) in step else []
                ways += [(step[i, r], 2 + late, "R") for r in "ua" if (i, r) in step]
            for j, cost, letter in ways:
                new[j] = min(new.get(j, (c + cost, a + letter)), (c + cost, a + letter))
        best = with_inserts(new)
    return min(best[j] for j in (0, 3) if j in best)


def plans_of(spark, rows):
    turns = conversations(spark, rows)
    plans = repair.plan_repairs(turns)
    left = {}
    for r in repair.repaired(turns, plans).orderBy("conv_id", "place").collect():
        left.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return {r["conv_id"]: r.asDict() for r in plans.collect()}, left, {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repair.repaired(turns, plans)).collect()}


def test_repairs_against_all_edits(spark):
    r = random.Random(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Sam", "s"], ["Yes.", "Why?", "no", "", "  ", None, "Go!", "tail. \n"]
    rows = [(c, r.choice([None, *range(4)]), r.choices(roles, [5, 5, 2, 1, 1, 1, 1, 1])[0], r.choice(texts)) for c in range(60) for _ in range(r.randint(1, 3))]
    plans, left, hashes = plans_of(spark, rows)
    for c in range(60):
        own = ordered([x[1:] for x in rows if x[0] == c])
        cost, audit, turns = cheapest(own)
        got, kinds = plans[c], faults(own)
        assert (got["cost"], got["audit"]) == (cost, audit), own
        assert left.get(c, []) == turns
        assert hashes.get(c, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
        assert [got[k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        initials = [x[1][:1] for x in own]
        assert got["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [x[0] for x in own if x[0] is not None]
        assert got["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)


def test_a_conversation_over_all_partitions(spark):
    """Nearly all turns are of one conversation, with nulls, repeats and other turns around it."""
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "user", "assistant", "tool"]), r.choice(["Right.", f"Number {t}.", f"open {t}", " "])) for t in range(3000)]
    rows += [(7, None, "system", "Be kind.")] * 3 + [(5, 1, "user", "Hm?"), (9, 1, "assistant", "Well."), (None, None, None, None)]
    plans, left, _ = plans_of(spark, rows)
    for c in (7, 5, 9, None):
        own = ordered([x[1:] for x in rows if x[0] == c])
        assert (plans[c]["cost"], plans[c]["audit"]) == in_turn(own)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in left.get(c, [])))
        assert plans[c]["duplicate"] == faults(own).count("duplicate")
    assert plans[7]["gaps"] == 0 and plans[None] | {"conv_id": 0} == {"conv_id": 0, "gaps": 0, "blank": 1, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 3, "audit": "D"}


def test_products_are_associative():
    r = random.Random(1)
    for _ in range(200):
        a, b, c = (r.choice([*repair.TURNS.values(), repair.deletes(2), repair.CLOSURE]) for _ in range(3))
        assert repair.product(repair.product(a, b), c) == repair.product(a, repair.product(b, c))


def test_repair_of_no_turns_and_long_texts(spark):
    assert repair.plan_repairs(conversations(spark, [])).count() == 0
    plans, left, _ = plans_of(spark, [(1, 0, "user", " " * 300_000 + "x" + " " * 300_000), (1, 2**63 - 1, "assistant", "word. " * 200_000), (1, -(2**63), "s", "S.")])
    assert plans[1]["audit"] == "KKK" and plans[1]["gaps"] == 2**63 - 1 and plans[1]["truncated"] == 1 and len(left[1][2][1]) == 1_200_000


def test_every_fault_of_the_query_occurs(spark):
    rows = QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01").collect()
    assert all(any(r[c] for r in rows) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")) and set("".join(r["audit"] for r in rows)) == set("KRDI")


# ---- 13 prefix trie -------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out[min(m), len(p)] = (
            min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below) for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def trie_of(spark, rows, bits=62):
    nodes = trie.prefix_trie(trie.with_shared_heads(trie.numbered(conversations(spark, rows))), bits).collect()
    assert len({(r["conv_id"], r["depth"]) for r in nodes}) == len(nodes)
    return {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in nodes}


@pytest.fixture(scope="module")
def shared():
    """Conversations that share turns, end early or have none left, with null turns, ties, repeats and null ids."""
    r = random.Random(13)
    rows = [(c, r.choice([None, 0, 1, 2, 3, 4]), r.choice(["user", "assistant", None, ""]), r.choice(["Hi.", "Hi.", "Ho é.", None, "", "🙂"])) for c in [*range(0, 24), *range(300, 330), 1200, 1301] for _ in range(r.randint(1, 5))]
    return rows + [(c, t, "user", f"turn {t}") for c in (40, 41, 42, 43) for t in range(4)] + [(None, 0, "user", "lost"), (205, 0, "user", "alone")]


@pytest.mark.parametrize("bits", [62, 3, 1])
def test_trie_against_brute_force(spark, shared, bits):
    """With few bits most groups are collisions, and must be split."""
    assert trie_of(spark, shared, bits) == brute_trie(shared)


def test_trie_of_a_long_conversation_and_of_none(spark):
    """More turns than a block holds: fingerprints, parents and sums are carried from block to block."""
    n = 2 * trie.BLOCK + 100
    h = zlib.crc32(b"301") % 6
    rows = [(300, t, "user", f"t{t}") for t in range(n)] + [(301, t, "user", f"t{t}") for t in range(n - 50)] + [(301, n, "user", "other"), (302, 0, "user", "short")]
    got = trie_of(spark, rows)
    assert got[300, 0][1] == 3 and got[300, n - 50][:3] == (300, 2, 2) and got[301, n - 49][:4] == (300, 1, 0, 1)
    assert all(got[300, d][:3] == (300, 2, 1) for d in range(7, n - 50)) and all(got[300, d][0] == 300 for d in range(1, n + 1))
    assert got[300, 7][3] == 2 and got[300, 7][4] == sum(len(f"t{t}") for t in range(6, n - 50)) and got[300, n] == (300, 1, 0, 1, 0, hashlib.sha256(b"300").hexdigest())
    assert h < 6 and trie_of(spark, []) == {}


# ---- 12 piece codec -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def test_pieces_against_the_library(library):
    codec, r = piece_bpe.codec(PIECE_BPE), random.Random(12)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    alphabets = ["a b  ", "ab ▁<>/s0x41é", "abcdefghijklmnopqrstuvwxyz    ", "日本語中文字 の.,", "etain osr", "\n\t ab.\x00퟿\U0001f600é"]
    texts = ["", " ", "  ", "</s><unk><0x41>", "▁▁", "x" * 5000, "ab " * 20_000, " " * 777]
    for _ in range(3000):
        texts.append("".join(r.choices(r.choice(alphabets), k=r.randint(0, 40))))
        texts.append("".join(r.choices(pieces, k=r.randint(1, 8))))
        texts.append(" " * r.randint(0, 50) + "".join(r.choices(pieces, k=2)).replace("▁", " ") + " " * r.randint(0, 50) + r.choice(["x", "é", "\n", "中"]))
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert ids.tolist() == library.encode(text, add_eos=True), text
        assert codec.decode(ids) == library.decode(ids.tolist()), text


def test_pieces_of_any_ids_are_decoded_as_by_the_library(library):
    codec, r = piece_bpe.codec(PIECE_BPE), random.Random(2)
    for _ in range(5000):
        ids = [r.randrange(r.choice([4, 262, 32000])) for _ in range(r.randint(0, 8))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_one_piece_alone_can_end_a_prefix(library):
    """Every prefix of a unit has exactly one compatible last piece, so that the table may keep the first one found."""
    codec = piece_bpe.codec(PIECE_BPE)
    for unit in ["▁internationalization", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁word", "▁aaaaaaaaaaaa", "▁the"]:
        last = codec.table(unit)
        for end in range(1, len(unit) + 1):
            fits = [i for i, p in codec.piece.items() if unit[:end].endswith(p) and (codec._compatible(last[end - len(p) - 1], i) if len(p) < end else True)]
            assert fits == [last[end - 1]]
            assert end == 1 or library.encode(unit[1:end].replace("▁", " "))[-1] == last[end - 1]


def test_piece_caches_can_be_full(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "CACHE_UNITS", 5)
    monkeypatch.setattr(piece_bpe, "CACHE_PAIRS", 3)
    monkeypatch.setattr(piece_bpe, "GROUP_UNITS", 4)
    monkeypatch.setattr(piece_bpe, "CACHED_LENGTH", 6)
    codec = piece_bpe.PieceCodec(PIECE_BPE)
    texts = ["a rather longer sentence, with internationalization in it " * 3, "one two three one two three", ""]
    assert [x.tolist() for x in codec.encode_all(texts)] == library.encode(texts, add_eos=True)


def test_frequent_units_stay_cached(monkeypatch, library):
    """New units push out those not asked for again, while a frequent one is encoded once; words of several units, and runs of spaces, are cut as before."""
    monkeypatch.setattr(piece_bpe, "CACHE_UNITS", 10)
    codec, encoded = piece_bpe.PieceCodec(PIECE_BPE), []
    unit_ids = codec.unit_ids
    monkeypatch.setattr(codec, "unit_ids", lambda unit: encoded.append(unit) or unit_ids(unit))
    texts = [f"often word{k}" for k in range(60)] + ["often\n\nthen  中 ▁ 文x  ", "x\ty " * 3]
    assert [x.tolist() for x in codec.encode_all(texts)] == library.encode(texts, add_eos=True)
    assert encoded.count("▁often") == 1 and len(codec.cache) + len(codec.older) <= 10


def test_piece_rows(spark, library):
    docs = spark.createDataFrame([(1, None, "k", 1), (2, "", "k", 1), (3, "word " * 60_000, "k", 1), (4, "Same.", "k", 1), (4, "Same.", "k", 1), (None, "中é\U0001f600", "k", 1)], "doc_id long, text string, ids string, decoded int")
    for r in piece_bpe.encode_decode(docs, PIECE_BPE).collect():
        text = r["text"] or ""
        assert list(r["ids"]) == library.encode(text, add_eos=True) and r["decoded"] == text
    lone = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in piece_bpe.decode(lone, PIECE_BPE).collect()] == ["", ""]
    assert piece_bpe.encode(docs.limit(0), PIECE_BPE).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_piece_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_piece_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
