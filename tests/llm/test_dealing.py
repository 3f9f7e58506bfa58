import numpy as np
import pyarrow as pa

from fathomline.llm import dealing as d


def test_records_come_back_in_their_group():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    h[:900] = h[900:1800]
    v = rng.integers(-(2**62), 2**62, 5000)
    for groups in (1, 7, 4096):
        b = d.dealt(h, groups, [h, v], 10)
        number = b.column("b").to_pylist()
        assert number == sorted(set(number)) and 10 <= min(number) and max(number) < 10 + groups
        got = [(x, y) for i in range(b.num_rows) for x, y in zip(*d.unpacked(pa.chunked_array([b.column("z").slice(i, 1)]), 2))]
        assert sorted(got) == sorted(zip(h.view(np.int64), v))
        meets = {}
        for i in range(b.num_rows):
            for x in d.unpacked(b.column("z").slice(i, 1), 2)[0]:
                assert meets.setdefault(x, i) == i
    assert d.dealt(h[:0], 3, [h[:0]]).num_rows == 0


def test_lists():
    a = d.dealt_by(np.array([5, -3, 5, 5, 9]), 1, [np.array([2, 1, 1, 2, 7]), np.array([0, 4, 6, 0, 8])])
    b = d.dealt_by(np.array([5]), 1, [np.array([0]), np.array([1])])
    rows = d.lists_of("u", ["s", "n"])(pa.Table.from_batches([a, b])).to_pylist()
    assert rows == [{"u": -3, "s": [1], "n": [4]}, {"u": 5, "s": [0, 1, 2], "n": [1, 6, 0]}, {"u": 9, "s": [7], "n": [8]}]


def test_order_and_groups():
    rng = np.random.default_rng(2)
    h, x, y = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(0, 3, 300), rng.integers(0, 3, 300)
    order = d.by_first([h, x, y])
    keys = list(zip(h[order], x[order], y[order]))
    assert keys == sorted(keys)
    run, first = d.spans(h[order])
    assert first.tolist() == [i for i in range(300) if not i or keys[i][0] != keys[i - 1][0]] and (np.diff(run) >= 0).all()
    sizes = [n / d.groups_for(n) for n in (1e3, 1e6, 1e9, 1e10, 1e13)]
    assert sizes == sorted(sizes) and sizes[-1] <= d.GROUP[1] * 1.01
