"""A shard of slices must be sorted in a part of LENGTH times its bytes."""

import tracemalloc

import numpy as np

from fleetlens.llm import suffix_dedup


def test_a_shard_is_sorted_without_copying_all_windows():
    """All windows sorted directly were copied at once: about 100 bytes for a byte of the shard."""
    rng = np.random.default_rng(3)
    vocabulary = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(5_000)]
    text = np.frombuffer(b" ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), 90_000)), np.uint8)
    tracemalloc.start()
    try:
        order = suffix_dedup.suffix_array(text)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * len(text)
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    raw, some = text.tobytes(), order[1_000:3_000].tolist()
    keys = [raw[i : i + suffix_dedup.LENGTH] for i in some]
    assert keys == sorted(keys)
