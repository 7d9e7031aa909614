"""Pieces are found in hash tables of which the later ones are asked for few hashes."""

import numpy as np

from mailflow.llm import lattice_lm as L


def test_later_tables_are_asked_about_taken_slots_alone(monkeypatch):
    monkeypatch.setattr(L.Lattice, "SLOTS", 8)
    pieces = [bytes([i]) for i in range(256)]
    lattice = L.Lattice(pieces)
    assert len(lattice.tables) > 2
    x = np.arange(256, dtype=np.uint8).reshape(-1, 1)
    known = L._range_hash(L._prefix(x), 0, 1)
    hashes = np.stack([known, known ^ np.uint64(1 << 63), np.zeros(256, np.uint64)])
    asked, slot = [], L.Lattice._slot
    monkeypatch.setattr(L.Lattice, "_slot", lambda self, h, t: asked.append(h.size) or slot(self, h, t))
    found = lattice.find(hashes)
    assert found.dtype == np.int32 and found[0].tolist() == list(range(256)) and (found[1:] == -1).all()
    assert asked[0] == hashes.size and all(a > b for a, b in zip(asked, asked[1:]))
    assert lattice.find(hashes[:, :0]).shape == (3, 0)
