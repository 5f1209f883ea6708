"""Problem 3: what changed between consecutive full snapshots of one table.

Snapshots are unpivoted into signed cells (+1 for the newer snapshot, -1 for the older) and summed by group, twice: first one
cell per row, whose value is the whole row, then, of the rows whose sum is not zero, one cell per field and one
key-presence marker.  What is equal on both sides sums to zero; the sums that are left classify the key and name the changed
fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Snapshots that one pass holds side by side in a grouped row; a pass reads its own snapshots only, and one of the pass before.
SNAPSHOTS_PER_PASS = 8
PRESENCE = "presence"


def _leaves(field: T.StructField, column: Column, path: str) -> list[tuple[str, Column]]:
    """Struct columns count field by field; a null struct equals one whose fields are all null."""
    if isinstance(field.dataType, T.StructType):
        return [x for f in field.dataType.fields for x in _leaves(f, column.getField(f.name), f"{path}.{f.name}")]
    return [(path, F.to_json(column) if isinstance(field.dataType, T.MapType) else column)]


def _as_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.ArrayType):
        return F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    return column.cast("string")


def _latest(df: DataFrame, keys: Sequence[str], snapshot: str, delivered: str, values: list[tuple[str, Column]], numbers: list[int]) -> DataFrame:
    """One row per key with the latest delivery of every snapshot side by side (s<number>).

    The maximum combines before the only shuffle, so a key that was delivered very often costs one row per map task.
    Deliveries that tie are meant to be equal; where they are not, the greatest row counts.
    """
    row = F.struct(F.col(delivered).alias("at"), F.struct(*(c.alias(f"f{i}") for i, (_, c) in enumerate(values))).alias("row"))
    rows = df.where(F.col(snapshot).isin(numbers)).where(" and ".join(f"`{k}` is not null" for k in keys))
    rows = rows.select(*keys, F.col(snapshot).alias("snapshot"), row.alias("delivery"))
    side = [F.max(F.when(F.col("snapshot") == n, F.col("delivery"))).alias(f"s{n}") for n in numbers]
    return rows.groupBy(*keys).agg(*side)


def snapshot_cells(df: DataFrame, keys: Sequence[str], snapshot: str, delivered: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Nonzero grouped sums of signed cells: (snapshot, *keys, field, value, sign_sum).

    snapshot is the newer one of two consecutive snapshots, by the numbers that were delivered at all; null is a value like
    any other; rows with a null key or snapshot are left out; an empty table, or a single snapshot, gives no rows.
    """
    numbers = [r[0] for r in df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().orderBy(snapshot).collect()]
    left_out = {*keys, snapshot, delivered, *ignore}
    fields = [f for f in df.schema.fields if f.name not in left_out]
    values = [x for f in fields for x in _leaves(f, F.col(f"`{f.name}`"), f.name)]
    kinds = dict(zip([n for n, _ in values], [f.dataType for f in df.select(*(c.alias(str(i)) for i, (_, c) in enumerate(values))).schema.fields], strict=True))

    def changed(part: list) -> DataFrame:
        wide = _latest(df, keys, snapshot, delivered, values, part)
        sides = [F.when(F.col(f"s{n}").isNotNull(), F.struct(F.lit(new).alias("snapshot"), F.lit(sign).alias("sign"), F.col(f"s{n}").getField("row").alias("row"))) for old, new in zip(part, part[1:], strict=False) for n, sign in ((old, -1), (new, 1))]
        rows = wide.select(*keys, F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("side")).select(*keys, "side.*")
        unequal = rows.groupBy("snapshot", *keys, "row").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
        cells = [F.struct(F.lit(name).alias("field"), _as_text(F.col("row").getField(f"f{i}"), kinds[name]).alias("value")) for i, (name, _) in enumerate(values)]
        cells.append(F.struct(F.lit(PRESENCE).alias("field"), F.lit(None).cast("string").alias("value")))
        cells = unequal.select("snapshot", *keys, "sign", F.explode(F.array(*cells)).alias("cell")).select("snapshot", *keys, "sign", "cell.*")
        return cells.groupBy("snapshot", *keys, "field", "value").agg(F.sum("sign").cast("int").alias("sign_sum")).where("sign_sum <> 0")

    if len(numbers) < 2:
        return changed([0, 1]).where("false")
    step = SNAPSHOTS_PER_PASS - 1
    passes = [changed(numbers[first : first + step + 1]) for first in range(0, len(numbers) - 1, step)]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def snapshot_changes(df: DataFrame, keys: Sequence[str], snapshot: str, delivered: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(snapshot, *keys, change, fields): added, removed or changed, with the sorted names of the changed fields.

    The sums are grouped on the partitioning by key that the only shuffle made.
    """
    cells = snapshot_cells(df, keys, snapshot, delivered, ignore)
    presence = F.sum(F.when(F.col("field") == PRESENCE, F.col("sign_sum")).otherwise(0))
    names = F.sort_array(F.collect_set(F.when(F.col("field") != PRESENCE, F.col("field"))))
    grouped = cells.groupBy("snapshot", *keys).agg(presence.alias("presence"), names.alias("fields"))
    change = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    fields = F.when(F.col("presence") == 0, F.col("fields")).otherwise(F.array().cast("array<string>"))
    return grouped.select("snapshot", *keys, change.alias("change"), fields.alias("fields"))
