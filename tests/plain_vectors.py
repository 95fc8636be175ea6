"""Plain forms of the chunks and the encoder, to test the column expressions against."""

import hashlib
import math

import numpy as np

DIM = 64


def chunk_words(text, budget=512, cost=lambda w: 1 + math.ceil(len(w) / 4)):
    chunks, used = [[]], 0
    for w in (text or "").split():
        if chunks[-1] and used + cost(w) > budget:
            chunks.append([])
            used = 0
        chunks[-1].append(w)
        used += cost(w)
    return [" ".join(c) for c in chunks]


def encode_text(text):
    v = np.zeros(DIM)
    for tok in filter(None, f"passage: {text}".split(" ")):
        h = int(hashlib.md5(tok.encode()).hexdigest()[:8], 16)
        v[h % DIM] += 1 - 2 * (h // DIM % 2)
    return v / (np.linalg.norm(v) or 1.0)


def embed_text(text, budget=512):
    return np.mean([encode_text(c) for c in chunk_words(text, budget)], axis=0)
