"""Small tables of vectors with nulls, ties, repeats, lengths that differ and columns that clash."""

from __future__ import annotations

SCHEMA = ("vec_id bigint, embedding array<double>, label int, node string, code string, whitened double, "
          "n_links string, row string, vec string")


def vector_rows(spark, rows):
    """``rows``: id, vector, label; other columns have names that the operators use for their own."""
    return spark.createDataFrame([(i, v, y, "n", "c", 1.0, "l", "r", "v") for i, v, y in rows], SCHEMA)


ODD = [
    (1, [1.0, 0.0, 2.0], 1), (1, [1.0, 0.0, 2.0], 1), (2, [2.0, 0.0, 4.0], 1), (3, [0.0, 0.0, 0.0], 1),
    (4, None, 1), (5, [1.0, None, 0.0], 1), (6, [float("nan"), 1.0, 1.0], 1), (7, [float("inf"), 0.0, 0.0], 1),
    (8, [1.0, 0.0, 2.0], None), (9, [1.0, 0.0, 2.0], None), (None, [1.0, 0.01, 2.0], 1), (10, [], 2),
    (11, [-1.0, 0.5], 2), (12, [-1.0, 0.5, 0.0], 2), (13, [0.3, -0.7, 0.1], 3),
]
