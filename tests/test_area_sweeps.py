"""Areas of crowded tiles by a few passes over arrays, and blocks of any size, against unit cells."""

import random

import numpy as np

from netloom.operators import geometry


def test_a_tile_takes_few_passes(monkeypatch):
    rng = random.Random(9)
    diamonds = [(rng.randrange(40), rng.randrange(40), rng.randint(1, 3)) for _ in range(250)]
    cells = {(u, v) for x, y, r in diamonds for u in range(x + y - r, x + y + r) for v in range(x - y - r, x - y + r)}
    pieces = np.array([(t[1], t[3], *t[4:]) for x, y, r in diamonds for t in geometry.trapezoids([(x, y - r), (x + r, y), (x, y + r), (x - r, y)])], float)
    passes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: passes.append(1) or sort(*a, **k))
    assert abs(geometry._united(pieces, -9.0, -9.0, 60.0, 60.0) - len(cells) / 2) < 1e-9
    assert len(passes) <= 3
    monkeypatch.setattr(geometry, "BLOCK", 700)
    assert abs(geometry._united(pieces, -9.0, -9.0, 60.0, 60.0) - len(cells) / 2) < 1e-9


def test_few_and_many_crossings_agree():
    rng = random.Random(2)
    for n in (2, 5, 16):
        rows = [(rng.uniform(0, 9), y := rng.uniform(0, 9), rng.uniform(0, 9), y + rng.uniform(0.1, 9)) for _ in range(n)]
        assert sorted(geometry._few_crossings(rows)) == sorted(geometry._crossings(np.array(rows)))
