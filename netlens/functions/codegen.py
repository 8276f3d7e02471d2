"""Keeping generated code of wide tables short enough to be compiled."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import SparkSession

LIMIT_KEY = "spark.sql.codegen.hugeMethodLimit"
#: Bytecode of a method beyond which the JVM only interprets it.
COMPILED_BYTES = 8000

_lock = Lock()
_inside: dict[str, tuple[int, str]] = {}


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside leave whole-stage code where its methods would only be interpreted.

    A projection or aggregate over many columns becomes one long method; without
    whole-stage code its expressions are compiled in pieces. The session's own limit
    returns when the last of several threads leaves.
    """
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        users, before = _inside.get(key) or (0, spark.conf.get(LIMIT_KEY))
        if not users:
            spark.conf.set(LIMIT_KEY, min(int(before), COMPILED_BYTES))
        _inside[key] = (users + 1, before)
    try:
        yield
    finally:
        with _lock:
            users, before = _inside.pop(key)
            if users > 1:
                _inside[key] = (users - 1, before)
            else:
                spark.conf.set(LIMIT_KEY, before)
