"""Addresses that arrive as a stream, resolved batch by batch against the gazetteer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import Geocoder
from ..fields import AddressFields


def geocode_stream(
    stream: DataFrame,
    geocoder: Geocoder,
    fields: AddressFields | dict[str, str],
    sink: Callable[[DataFrame, int], None],
    *,
    checkpoint: str,
    **options,
) -> StreamingQuery:
    """Geocode each micro-batch and hand it to the sink with its number.

    A batch can come again after a failure: the sink should replace what it wrote for that number.
    """

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            sink(geocoder.geocode(df, fields, **options), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
