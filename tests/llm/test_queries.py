"""The corpus queries against their SQL, and the pipeline's stages against plain Python, on the smallest tables."""

import collections
import hashlib
import html
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from factorloom.llm.common import stage  # noqa: E402
from factorloom.llm import language_id  # noqa: E402
from factorloom.llm.queries import BYTE_BPE, ORACLE_SQL, PIECES, QUERIES  # noqa: E402
from tests.llm.test_operators import brute_classes, brute_mix  # noqa: E402
from tests.oracle import assert_same, connection  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name])


def test_every_outcome_of_a_revisit_occurs(spark):
    outcomes = {r["outcome"]: r["count"] for r in QUERIES["op1_warc_revisits"](spark, "/root/testdata/sf0.01").groupBy("outcome").count().collect()}
    assert set(outcomes) == {"resolved", "mismatch", "no_validator", "no_response", "no_url"}


def test_bpe_digests(spark):
    known = tokenizers.Tokenizer.from_file(BYTE_BPE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe"](spark, SF).collect():
        ids = known.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language_accuracy_on_held_out_documents(spark):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(truth, "doc_id").where("held_out AND lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_query_against_brute_force(spark):
    """Predictions and scores of every text by a plain sum over segmentations, word by word, with the probabilities that were learned."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs.select("doc_id", "text", "lang"), PIECES)
    ids = {p: i for i, p in enumerate(model.pieces)}
    longest, known = max(map(len, ids)), {}

    def likelihoods(word):
        if word not in known:
            ways = [np.ones(len(model.languages))]
            for j in range(1, len(word) + 1):
                total = 0
                for i in range(max(0, j - longest), j):
                    piece = ids.get(word[i:j], -1 if j == i + 1 else None)
                    if piece is not None:
                        total = total + ways[i] * model.p[piece]
                ways.append(total)
            known[word] = np.log(ways[-1])
        return known[word]

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in QUERIES["op3_language_id"](spark, SF).collect():
        words = [w for w in language_id.words_of(texts[r["doc_id"]] or "")]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = sum(map(likelihoods, words))
        share = np.exp(total - total.max())
        assert r["lang_pred"] == model.languages[int(total.argmax())] and r["score"] == pytest.approx(1 / share.sum(), rel=1e-6)


def test_near_dedup_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op5_near_dedup"](spark, SF).collect()} == brute_classes(texts)


def test_html_query(spark):
    """Against the articles that a plain parser of the template finds."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op7_html_text"](spark, SF).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_query_counts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = QUERIES["op7_html_text"](spark, SF)
    assert got.count() == pages.count()
    row = got.orderBy("page_id").first()
    assert row["n_chars"] == len(row["text"]) and "©" not in row["text"] and "track(" not in row["text"]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        step(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k < 4:
            assert docs.columns == list(rows[0])
        ids = collections.Counter(r["doc_id"] for r in after)
        if name == "language ID":
            assert {r["doc_id"] for r in before} - set(ids) == {r["doc_id"] for r in before if not any(c.isalpha() for c in r["text"] or "")}
        elif name == "exact dedup":
            groups = {}
            for r in before:
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                groups[key] = max(groups.get(key, -1), r["doc_id"])
            assert set(ids) == set(groups.values())
        elif name == "MinHash near-dedup":
            assert set(ids) == set(brute_classes({r["doc_id"]: r["text"] for r in before}).values())
        elif name == "mixing":
            want, _ = brute_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before])
            assert ids == collections.Counter({i: t // n for i, n, t in want if t})
        else:
            known = tokenizers.Tokenizer.from_file(BYTE_BPE)
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before) and all(list(r["ids"]) == known.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in after)


def test_pipeline_on_odd_rows_and_none(spark):
    """Nulls in every column, empty and very long texts, repeated rows; then a table without rows."""
    own = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", None, "web", 0), (9003, "la " * 50_000, None, None, 1), (None, "the same of and that", None, None, 2), (9004, "*** 1 2", "en", "web", 3)] + [(9005, "of the and this that", "en", None, 4)] * 3,
        own.schema,
    )
    rows = own.unionByName(odd)
    docs = rows
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        docs = stage(docs, "test")
        assert docs.columns == rows.columns, name
        if name != "mixing":  # which may leave a document out
            out = collections.Counter(r["doc_id"] for r in docs.collect())
            assert not out.keys() & {9001, 9002, 9004} and out[9003] == 1 and out[9005] == (3 if name == "language ID" else 1), name
    assert docs.count() == corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    docs = rows.limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.count() == 0, name
