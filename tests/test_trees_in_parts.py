"""Trees of a batch are made a part at a time."""

import pyarrow as pa

from quarryline.functions import uast


def test_few_rows_of_a_batch_are_objects_at_once():
    held, most = [], []

    def f(x):
        held.append(x)
        most.append(len(held))
        return [b"x"]

    class Column(list):
        def slice(self, i, n):
            held.clear()
            return pa.array(self[i : i + n])

    n = 3 * uast.AT_ONCE + 1
    out = uast._columns(f, pa.list_(pa.binary()))(Column(range(n)))
    assert out.to_pylist() == [[b"x"]] * n and max(most) == uast.AT_ONCE
    assert uast._tokens(pa.array([], pa.list_(pa.binary()))).type == pa.list_(pa.string())
