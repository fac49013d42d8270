import re

import numpy as np
import pyarrow as pa

from ravelin.llm import wordhash as W
from tests.llm.brute import LOWER


def test_words_equal_the_pattern(rng):
    alphabet = "aB z\t\n-é🙂9\x00\x0b_"
    texts = ["", "a", " ", None, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300))]
    for is_separator, pattern in ((W.BLANKS, "[^\x20\x09-\x0d]+"), (W.NON_WORD, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        seen: dict[int, str] = {}
        for limit in (7, 1 << 20):
            for start, stop, data, offsets in W.text_slices(pa.array(texts), limit):
                words = W.words_of(data, offsets, is_separator)
                for i in range(stop - start):
                    want = re.findall(pattern, (texts[start + i] or "").translate(LOWER))
                    got = words.hashes[words.first[i]:words.first[i + 1]].tolist()
                    assert len(got) == len(want)
                    assert all(seen.setdefault(h, w) == w for h, w in zip(got, want))
        assert len(set(seen.values())) == len(seen)


def test_windows_stay_in_rows():
    data = np.frombuffer(b"a b c d e f", np.uint8)
    words = W.words_of(data, np.array([0, 6, 6, 11]), W.BLANKS)
    keys, at = W.windows(words, 3)
    assert at.tolist() == [0, 3] and keys[0] != keys[1]
    assert len(W.windows(words, 4)[0]) == 0


def test_array_slices_with_offset():
    column = pa.array(["x", "one two", None, "three"]).slice(1)
    got = [(a, b, bytes(d)) for a, b, d, _ in W.text_slices(column, 3)]
    assert got == [(0, 1, b"one two"), (1, 2, b""), (2, 3, b"three")]


def test_permutation_is_one_and_keyed():
    from ravelin.llm.training_order import permuted

    for n in (1, 2, 3, 17, 1000, 4097):
        slots = permuted(np.arange(n), n, 7)
        assert sorted(slots.tolist()) == list(range(n))
        assert np.array_equal(np.concatenate([permuted(np.arange(a, min(n, a + 100)), n, 7) for a in range(0, n, 100)]), slots)
    assert not np.array_equal(permuted(np.arange(1000), 1000, 7), permuted(np.arange(1000), 1000, 8))
    assert abs(np.corrcoef(np.arange(4097), permuted(np.arange(4097), 4097, 7))[0, 1]) < 0.1
