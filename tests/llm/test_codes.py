"""Vector codes against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from arealis.llm import codes

COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
SCHEMA = "vec_id long, embedding array<double>, label int, part int, code string"


def brute(rows):
    """(vec_id, embedding, label) to the rows of a result."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    sizes = [len(r[1]) for r in kept]
    size = min(set(sizes), key=lambda s: (-sizes.count(s), s))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    own = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in kept if len(v) == size]
    borders = [i * size // 8 for i in range(9)]
    part = [[v[a:b] for a, b in zip(borders, borders[1:], strict=False)] for _, v, _ in own]
    books = [[p[k] for p in part[:16]] for k in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, k: min(range(len(books[k])), key=lambda j: (far(p[k], books[k][j]), j))
    for _ in range(6):
        groups = [defaultdict(list) for _ in range(8)]
        for p in part:
            for k in range(8):
                groups[k][near(p, k)].append(p[k])
        for k in range(8):
            for j, found in groups[k].items():
                books[k][j] = [sum(x) // len(found) for x in zip(*found, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for p, (i, _, label) in zip(part, own, strict=True):
        code = [near(p, k) for k in range(8)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(p[k], books[k][c]) for k, c in enumerate(code)), label))
    out += [(i, None, None, label) for i, v, label in kept if len(v) != size]
    total = defaultdict(lambda: None)
    for _, _, error, label in out:
        if error is not None:
            total[label] = (total[label] or 0) + error
    small = lambda x: x if x is None or x < 1 << 63 else None
    return [(i, c, small(e), small(total[label]), sha) for i, c, e, label in out]


def vectors(n, size, spread=1.0):
    rng = random.Random(n)
    centres = [[rng.gauss(0, spread) for _ in range(size)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, spread / 3) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]
    return rows + [(3, rows[3][1], 7), (n, rows[5][1], None), (None, rows[6][1], 1), (n + 1, [0.0] * size, 0), (n + 2, [0.0] * size, 0)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(
    "rows",
    [
        vectors(300, 24),
        vectors(40, 13) + [(90, [1.0] * 8, 0), (91, None, 0), (92, [float("nan")] * 13, 0), (93, [1.0, None] + [0.0] * 11, 1), (94, [float("inf")] * 13, 1)],
        vectors(30, 16) + [(95, [1e30] * 16, 5), (96, [-3e6] * 16, 6), (97, [1e300] * 16, 6)],
        vectors(9, 8)[:7],
        [(i, [k / 2 for k in ((i * 7) % 3, i % 2, 0, 1, i % 5, 0, 0, 2)], 0) for i in range(60)],
        [(1, [], 0), (2, [], 0)],
    ],
)
def test_vector_codes(spark, same, rows):
    same(codes.compressed(frame(spark, rows)), COLUMNS, brute(rows))


def test_no_vectors(spark):
    empty = codes.compressed(frame(spark, [(1, None, 0)]))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_cells_leave_the_nearest_and_drop_others():
    rng = np.random.default_rng(1)
    entries = rng.integers(-300, 300, (16, 4))
    entries[9] = entries[2]
    points = np.concatenate([rng.integers(-400, 400, (3000, 4)), entries, (entries[:8] + entries[8:]) // 2])
    grid = codes.Grid(entries.tolist(), 4)
    far = ((points[:, None] - entries[None]) ** 2).sum(2)
    entry, best = grid.nearest(points)
    assert (entry == far.argmin(1)).all() and (best == far.min(1)).all()
    assert [grid.nearest_of_large(p) for p in points[:50].tolist()] == list(zip(entry[:50].tolist(), best[:50].tolist(), strict=True))
    masks = grid.candidates(points)
    assert np.mean([bin(m).count("1") for m in masks.tolist()]) < 5
    cells = len(grid.cells)
    assert (grid.candidates(points[::-1])[::-1] == masks).all() and len(grid.cells) == cells < len(points)


def test_decoded_vectors_are_near(spark):
    rows = vectors(200, 16)
    usable, size = codes.usable(frame(spark, rows))
    books = codes.fit(usable, size)
    for r in codes.decoded(codes.encode(usable, books), books).where("vec_id BETWEEN 10 AND 40").collect():
        x = [math.floor(4096 * v) for v in rows[r["vec_id"]][1]]
        assert sum((a - 4096 * b) ** 2 for a, b in zip(x, r["decoded"], strict=True)) == pytest.approx(r["error"])
