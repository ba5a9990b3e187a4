"""Connecting alike rows inside one task, and dealing rows to tasks so that all pairs meet."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def forest_edges(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what ``alike`` connects, fewer than ``n``.

    ``alike(i, others)`` gives the positions among ``others`` that are like ``i``; only positions
    of other classes are asked about. Rows of the largest class are put off, and once all rows
    that haven't asked are in it nothing is left to find: of two rows in different classes one is
    outside the largest, and that one has asked about the other.
    """
    label, size = np.arange(n), np.ones(n, np.int64)
    out: list[tuple[int, int]] = []
    queue, big = list(range(n)), -1
    while queue:
        later = []
        for i in queue:
            if label[i] == big:
                later.append(i)
                continue
            for j in alike(i, np.flatnonzero(label != label[i])):
                a, b = label[i], label[j]
                if a != b:
                    a, b = (a, b) if size[a] >= size[b] else (b, a)
                    label[label == b] = a
                    size[a] += size[b]
                    out.append((i, int(j)))
                    if big < 0 or size[a] > size[big] or big == b:
                        big = a
        queue = [i for i in later if label[i] != big]
    return out


def deal_to_tiles(rows: DataFrame, pieces: Column) -> DataFrame:
    """``rows`` with ``_part``, ``_i`` and ``_j``, copied so that any two rows with a key meet in one tile.

    ``pieces`` is the number of parts that the key's rows are cut into. A row's part is a hash of
    its ``id``; it goes to the tiles of its part with every part, so tasks stay as large as a
    part however large the key is.
    """
    spread = rows.withColumn("_part", F.pmod(F.xxhash64("id"), pieces).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))))
    return spread.withColumn("_i", F.least("_part", "_other")).withColumn("_j", F.greatest("_part", "_other")).drop("_other")
