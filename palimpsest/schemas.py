"""Schemas of the index tables and of results."""

from pyspark.sql import types as T


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(name, kind(), null) for name, (kind, null) in kinds.items()])


LONG, TEXT, TIME = T.LongType, T.StringType, T.TimestampType

DOCS = _fields(path=(TEXT, False), mtime=(TIME, True), length=(LONG, True), content=(T.BinaryType, True))
PATHS = _fields(path_id=(LONG, False), path=(TEXT, False), word_count=(LONG, False), mtime=(TIME, True))
POSTINGS = _fields(letter=(TEXT, False), word=(TEXT, False), path_id=(LONG, False))
RESULT = _fields(rank=(LONG, False), path_id=(LONG, False), path=(TEXT, True), count=(LONG, False))
CHECKS = _fields(check=(TEXT, False), ok=(T.BooleanType, False), violations=(LONG, False), sample=(TEXT, True))
