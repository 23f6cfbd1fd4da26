"""Schemas of corpora and of API pages; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


WORKS = struct(
    ord=_LONG,
    id=_TEXT,
    title=_TEXT,
    year=_INT,
    cited_by_count=_LONG,
    referenced_works=T.ArrayType(_TEXT),
    concepts=T.ArrayType(struct(id=_TEXT, name=_TEXT, level=_INT, score=_DOUBLE)),
    topics=T.ArrayType(struct(id=_TEXT, name=_TEXT, score=_DOUBLE, subfield=_TEXT, field=_TEXT, domain=_TEXT)),
    abstract=_TEXT,
)
#: What a line of a corpus file must have; the rest may be missing in older files.
REQUIRED = ("id", "cited_by_count", "referenced_works", "concepts")
_NAMED = struct(display_name=_TEXT)
PAGE = struct(
    meta=struct(count=_LONG, next_cursor=_TEXT, cost_usd=_DOUBLE),
    results=T.ArrayType(
        struct(
            id=_TEXT,
            display_name=_TEXT,
            publication_year=_INT,
            cited_by_count=_LONG,
            referenced_works=T.ArrayType(_TEXT),
            concepts=T.ArrayType(struct(id=_TEXT, display_name=_TEXT, level=_INT, score=_DOUBLE)),
            topics=T.ArrayType(struct(id=_TEXT, display_name=_TEXT, score=_DOUBLE, subfield=_NAMED, field=_NAMED, domain=_NAMED)),
            abstract_inverted_index=T.MapType(_TEXT, T.ArrayType(_LONG)),
        )
    ),
)
ID_PREFIX = "https://openalex.org/"
