"""Rows-only queries checked against brute force on the sf0.001 fixture."""

import json

import numpy as np
import plain_vectors as plain
from pyspark.sql import functions as F

from tagwise.functions import text as T
from tagwise.plans.registry import load_all
from tagwise.sources import conv_text, fixtures

REG = load_all()


def test_json_or_raw_matches_python(spark, sf):
    got = {r.event_id: r.is_json for r in REG["json_or_raw"].fn(spark, sf).collect()}
    src = conv_text.event_payloads(spark, sf).collect()

    def parses(t):
        try:
            json.loads(t)
            return True
        except (TypeError, ValueError):
            return False
    assert got == {r.event_id: parses(r.payload) for r in src}


def test_chunk_by_budget_matches_python(spark, sf):
    got = {(r.id, r.chunk_no): r.n_words for r in REG["chunk_by_budget"].fn(spark, sf).collect()}
    docs = fixtures.posts(spark, sf).select("id", T.clean_for_embedding(F.col("content")).alias("t")).collect()
    want = {}
    for d in docs:
        for i, ch in enumerate(plain.chunk_words(d.t or "", 512)):
            want[(d.id, i)] = len(ch.split())
    assert got == want


def test_embed_chunks_norm_matches_numpy(spark, sf):
    got = {r.id: (r.n_vectors, r.norm) for r in REG["embed_chunks"].fn(spark, sf).collect()}
    docs = fixtures.posts(spark, sf).select("id", T.clean_for_embedding(F.col("content")).alias("t")).collect()
    for d in docs:
        chunks = plain.chunk_words(d.t or "", 512)
        mean = np.mean([plain.encode_text(c) for c in chunks], axis=0)
        n, norm = got[d.id]
        assert n == len(chunks) and abs(norm - round(float(np.linalg.norm(mean)), 6)) < 1e-6


def test_lsh_recall_is_high(spark, sf):
    r = REG["knn_lsh_recall"].fn(spark, sf).first()
    assert r.n_exact > 0 and r.recall >= 0.8
