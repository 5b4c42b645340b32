"""Memory of a bucket of super-k-mers: a small multiple of its text."""

import tracemalloc

import numpy as np

from factloom.llm import suffix_array_dedup as s


def test_string_minimisers_in_batches():
    rng = np.random.default_rng(5)
    lengths = rng.integers(50, 81, 60_000)
    text = rng.integers(97, 123, int(lengths.sum())).astype(np.uint8)
    ends = np.cumsum(lengths)
    strings = [text[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    want, _ = s.minimisers(text, lengths, 50, 20)
    tracemalloc.start()
    got = s._string_minimisers(strings, lengths, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want[ends - lengths]).all()
    assert peak < 6 * len(text), peak  # all at once: some 40 bytes a byte
    assert len(s._string_minimisers([], lengths[:0], 50)) == 0
