"""Small corpora with hand-computed results."""

from __future__ import annotations

from lacuna.sources.schema import WORKS


def work(ord, id=None, labels=(), year=2020, refs=(), title=None, abstract=None, cited=0, concepts=None):
    """A work with the same labels in both taxonomies; (id, name) pairs or names."""
    named = [x if isinstance(x, tuple) else (x, x) for x in labels]
    tags = concepts if concepts is not None else [(f"C-{i}", n, 2, 0.5) for i, n in named]
    return (ord, id or f"W{ord}", title, year, cited, list(refs), tags, [(f"T-{i}", n, 0.9, None, None, None) for i, n in named], abstract)


def frame(spark, works):
    return spark.createDataFrame(works, WORKS)


#: Label sets of ten works.
TEN = ["ABD", "ABD", "AB", "AB", "AB", "ABC", "ACD", "ACD", "C", "C"]


def ten(spark):
    extra = [("C-Chemistry", "Chemistry", 1, 0.9), ("C-Noise", "Noise", 3, 0.39)]
    return frame(spark, [work(i, labels=s, concepts=[(f"C-{x}", x, 2, 0.5) for x in s] + extra) for i, s in enumerate(TEN)])
