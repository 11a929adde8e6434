"""Frames of a stream of concatenated JPEG pictures."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..shipping import ship

_START, _END = b"\xff\xd8", b"\xff\xd9"


def split_frames(data: bytes | None) -> Iterator[tuple[int, bytes]]:
    """(number, picture) from start marker to end marker; an unfinished last picture and what lies between are left out."""
    at, number = 0, 0
    data = bytes(data or b"")
    while (a := data.find(_START, at)) >= 0 and (b := data.find(_END, a + 2)) >= 0:
        yield number, data[a : b + 2]
        at, number = b + 2, number + 1


@udtf(returnType="frame int, content binary")
class Frames:
    def eval(self, data: bytes):
        yield from split_frames(data)


def register(spark: SparkSession) -> None:
    """Make frames(data) available in SQL as a table function."""
    spark.udtf.register("frames", Frames)


ship(sys.modules[__name__])
