"""What a key sends to be met by keys that it holds: few of its parts, but always the one that a held key looks for."""

import random

import numpy as np
import pyarrow as pa

from quillon.operators import containment


def parts_of(keys, kind, counts):
    ((_, data, ends),) = containment._pieces(pa.RecordBatch.from_arrays([pa.array(keys)], names=["k"]))
    _, width, window = containment.KINDS[kind]
    value, row, first = containment._parts(data, ends, width)
    rank = containment._rank(value, counts)
    return value, row, first, rank, containment._least(rank, row, window)


def test_few_parts_are_sent_and_the_rarest_of_a_held_key_is_among_them():
    rng = random.Random(3)
    keys = [f"GBT{rng.randrange(10**8)}_{rng.randrange(7)}_{rng.randrange(1000)}" for _ in range(2000)]
    counts = np.zeros(containment.SLOTS, np.uint32)
    value, row, first, rank, sent = parts_of(keys, 0, counts)
    np.add.at(counts, containment._slot(containment._mixed(value)), 1)
    value, row, first, rank, sent = parts_of(keys, 0, counts)
    assert sent.sum() < 0.6 * len(value)
    for i in range(0, 2000, 7):
        begin = rng.randrange(len(keys[i]) - 10)
        held = keys[i][begin : begin + rng.randrange(11, 16)]
        v, _, _, r, _ = parts_of([held], 0, counts)
        assert v[np.argmin(r)] in value[first[i] : first[i + 1]][sent[first[i] : first[i + 1]]]
