import hashlib
import math
import random

import numpy as np
import pytest

from terrane.llm import codes

DDL = "vec_id long, embedding array<double>, label int, code string"


def plain(rows, rounds=2, entries=64):
    """The contract with Python's integers and no transform."""
    rows = [(i, v, g) for i, v, g, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not rows:
        return []
    size = max(1, -(-max(len(v) for _, v, _ in rows) // 16))
    whole = lambda v: [int(math.floor(x * 256)) if abs(x) < 1e300 else int(x) * 256 for x in v] + [0] * (16 * size - len(v))
    rows = [(i, v, whole(v), g) for i, v, g in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    part = lambda x, p: x[p * size : (p + 1) * size]
    books = [[part(x, p) for _, _, x, _ in rows[:entries]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda x, p: min((far(part(x, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for _, _, x, _ in rows:
            for p in range(16):
                groups.setdefault((p, pick(x, p)[1]), []).append(part(x, p))
        for (p, k), xs in groups.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{pick(x, p)[1]:02x}" for p in range(16)), sum(pick(x, p)[0] for p in range(16)), g) for i, _, x, g in rows]
    total = {}
    for _, _, e, g in out:
        total[g] = total.get(g, 0) + e
    fit = lambda x: x if x < 1 << 63 else None
    return [(i, c, fit(e), fit(total[g]), sha) for i, c, e, g in out]


def table(seed=0, n=300, d=64, scale=1.0):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) * scale for _ in range(d)], r.choice([0, 0, 0, 1, None]), "c") for i in range(n)]
    rows += [(r.randrange(n), rows[k][1], 1, "c") for k in range(20)]
    return rows + [(n, None, 1, "c"), (n + 1, [None] * d, 0, "c"), (n + 2, [float("nan")] + [0.0] * (d - 1), 0, "c"), (n + 3, [float("-inf")] * d, 0, "c"), (None, [0.5] * d, None, "c"), (-5, [0.0] * d, 2, "c")]


def key(r):
    return (r[0] is None, r[0] or 0, str(r))


@pytest.mark.parametrize("rows", [table(), table(1, 100, 48), table(2, 40, 64), table(3, 120, 70), [*table(4, 90, 64), (7, [1.0, 2.0], 3, "c"), (8, [], 3, "c")]])
def test_like_brute_force(spark, rows):
    got = [tuple(r) for r in codes.report(spark.createDataFrame(rows, DDL).repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_large_numbers(spark):
    """Values beyond what 64 bits can square; errors of 2**63 and more are null."""
    rows = table(5, 80, 32, 1e6) + [(500, [1e9] * 32, 1, "c"), (501, [-1e300] * 32, 2, "c"), (502, [3e18] * 31 + [0.1], 2, "c")]
    got = [tuple(r) for r in codes.report(spark.createDataFrame(rows, DDL)).collect()]
    want = plain(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and any(w[2] is not None for w in want)


def test_empty(spark):
    assert codes.report(spark.createDataFrame([], DDL)).count() == 0
    assert codes.report(spark.createDataFrame([(1, None, 1, "c")], DDL)).count() == 0


def test_elimination_by_hand():
    """Ties go to the lower index; equal entries; one entry; sizes that are no power of two."""
    r = np.random.default_rng(2)
    for size in (1, 2, 3, 4, 5, 8):
        x, book = r.integers(-40, 40, (200, size)), r.integers(-40, 40, (30, size))
        book[7] = book[3]
        x[0] = book[3]
        code, far = codes.nearest(x, book)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (far == d.min(1)).all() and code[0] == 3
        assert (codes.nearest(x, book[:1])[0] == 0).all()


def test_walsh():
    for m in (1, 2, 4, 8, 16):
        h = codes.walsh(m)
        assert (h @ h.T == m * np.eye(m, dtype=int)).all()
        assert [(np.diff(row) != 0).sum() for row in h] == list(range(m))
