"""A bounded sample for fitting a model; everything else covers all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, text: str, rows: int) -> list[str]:
    """At most `rows` texts, spread over the table by a hash of the text.

    The hash thins every partition to its share before anything moves; the limit keeps the bound where one text is
    repeated without end.
    """
    texts = df.select(F.col(text).alias("text")).where("text is not null")
    total = texts.count()
    if total > rows:
        texts = texts.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    return [r.text for r in texts.limit(rows).collect()]
