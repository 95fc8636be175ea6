import numpy as np
import pyarrow as pa
import pytest

from tagwise.llm import words as W


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 16384])
def test_patterned_words_do_not_collide(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    buf, offs = W.text_buffer(pa.array([f"{word} {other} {word}", other]))
    h, first = W.hash_words(buf, offs)
    assert first.tolist() == [0, 3, 4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_equal_words_hash_alike_wherever_they_stand():
    r = np.random.default_rng(1)
    vocab = ["".join(r.choice(list("abcé"), r.integers(1, 9))) for _ in range(300)]
    pick = [vocab[i] for i in r.integers(0, 300, 5000)]
    buf, offs = W.text_buffer(pa.array([" ".join(pick[:2000]), "  ".join(pick[2000:])]))
    h, _ = W.hash_words(buf, offs)
    seen = {}
    for w, x in zip(pick, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
