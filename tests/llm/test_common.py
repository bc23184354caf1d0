from __future__ import annotations

import weakref

import numpy as np

from lakemart.llm import common


def test_memory_goes_back_after_a_task_lets_go_of_its_rows(monkeypatch):
    held, alive = [], []

    def task(batches):
        for n in batches:
            block = np.zeros(n)
            held.append(weakref.ref(block))
            yield n

    monkeypatch.setattr(common, "give_back", lambda: alive.append([x() is not None for x in held]))
    assert list(common.released(task)(iter([1, 2]))) == [1, 2]
    assert alive == [[False, False]]
