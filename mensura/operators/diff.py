"""Differences between two copies of a dataset, row by row and field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a hash bucket that one cogroup call holds as Arrow tables.
ROWS_PER_BUCKET = 250_000


def _once(df: DataFrame, keys: Mapping[str, Column], fields: Mapping[str, Column], latest: Column | None) -> DataFrame:
    """One row per key: repeated rows count once. Reduced on the map side, so a hot key costs a row per task.

    Of rows with one key that differ, the latest counts; of several latest ones the largest (nulls last).
    """
    rank = F.struct(
        *([latest.alias("_at")] if latest is not None else []),
        *[x.alias(f"_f{i}") for i, x in enumerate(fields.values())],
    )
    rows = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys.values())], rank.alias("_row"))
    one = rows.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.max("_row").alias("_row"))
    names = [f"_k{i}" for i in range(len(keys))]
    return one.select(
        F.xxhash64(*names).alias("_hash"),
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        *[F.col(f"_row._f{i}").alias(f) for i, f in enumerate(fields)],
    )


def _order(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    return np.asarray(pc.sort_indices(table, sort_keys=[("_hash", "ascending"), *[(k, "ascending") for k in keys]]))


def _aligned(a: pa.Table, b: pa.Table, keys: Sequence[str]) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]:
    """Both tables sorted by key hash; position in b of each row of a or -1; and the other way round.

    The search is on the 64-bit key hash. Hashes that occur twice on a side (a collision of two keys) and hits whose
    keys differ are settled key by key.
    """
    a, b = a.take(pa.array(_order(a, keys))), b.take(pa.array(_order(b, keys)))
    ha, hb = a["_hash"].to_numpy(), b["_hash"].to_numpy()
    at = np.searchsorted(hb, ha)
    inside = np.minimum(at, max(len(hb) - 1, 0))
    hit = (at < len(hb)) & (hb[inside] == ha) if len(hb) else np.zeros(len(ha), bool)
    for k in keys:
        if hit.any():
            x, y = a[k].combine_chunks(), b[k].combine_chunks().take(pa.array(inside))
            same = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False) | (pc.is_null(x).to_numpy(zero_copy_only=False) & pc.is_null(y).to_numpy(zero_copy_only=False))
            hit &= same
    to_b = np.where(hit, inside, -1)
    twice = np.isin(hb, hb[1:][hb[1:] == hb[:-1]]) if len(hb) > 1 else np.zeros(len(hb), bool)
    if twice.any():
        rows = {tuple(r[k] for k in keys): i for i, r in zip(np.flatnonzero(twice), b.filter(pa.array(twice)).select(list(keys)).to_pylist())}
        for i in np.flatnonzero(np.isin(ha, hb[twice])):
            to_b[i] = rows.get(tuple(a[k][int(i)].as_py() for k in keys), -1)
    to_a = np.full(len(hb), -1, dtype=np.int64)
    to_a[to_b[to_b >= 0]] = np.flatnonzero(to_b >= 0)
    return a, to_b, b, to_a


def _differs(x: pa.ChunkedArray, y: pa.ChunkedArray, tolerance: float) -> np.ndarray:
    """Null-aware mask: missing against not missing, numbers further apart than tolerance, other values unequal."""
    nx, ny = (pc.is_null(v, nan_is_null=True).to_numpy(zero_copy_only=False) for v in (x, y))
    if pa.types.is_floating(x.type):
        gap = np.abs(np.nan_to_num(x.to_numpy(zero_copy_only=False)) - np.nan_to_num(y.to_numpy(zero_copy_only=False))) > tolerance + 1e-9
    else:
        gap = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
    return (nx != ny) | (~nx & ~ny & gap)


def differences(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, tuple[Column, Column]],
    fields: Mapping[str, tuple[Column, Column]],
    tolerance: float = 0.0,
    latest: tuple[Column | None, Column | None] = (None, None),
    only_left: str = "only_in_left",
    only_right: str = "only_in_right",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(keys..., field_name, left_value, right_value): each difference between two copies of a dataset once.

    keys and fields map a name to its expression on either side, already in comparable form (the same type; missing
    values null or NaN). Rows missing on a side give field_name `only_left` or `only_right` with null values; for
    rows on both sides each differing field gives a row with both values as text. A null key is a key like any
    other. Repeated rows count once; of rows of one side with one key and other values the latest counts. Two empty
    sides give an empty table; an empty side gives every row of the other. Extra columns, also with clashing names,
    don't matter, as only keys and fields are taken.

    Both sides are reduced to a row per key before anything else, so that a hot key can't fill a bucket; keys are
    then spread over hash buckets (as many as keep them near rows_per_bucket, by a count of the reduced rows) that
    are cogrouped as Arrow tables, aligned by sorted search and compared column by column.
    """
    a = _once(left, {k: v[0] for k, v in keys.items()}, {k: v[0] for k, v in fields.items()}, latest[0])
    b = _once(right, {k: v[1] for k, v in keys.items()}, {k: v[1] for k, v in fields.items()}, latest[1])
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(left.count(), right.count())
    buckets = max(partitions, -(-size // rows_per_bucket))
    names, key_types = list(fields), [a.schema[k].dataType for k in keys]
    key_list = list(keys)
    schema = ", ".join([*[f"`{k}` {t.simpleString()}" for k, t in zip(keys, key_types)], "field_name string, left_value string, right_value string"])

    def compare(_: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        x, to_y, y, to_x = _aligned(x, y, key_list)
        parts = []

        def emit(source: pa.Table, rows: np.ndarray, field: str, values: tuple[pa.ChunkedArray, pa.ChunkedArray] | None) -> None:
            n = len(rows)
            if n:
                got = source.select(key_list).take(pa.array(rows))
                text = [v.cast(pa.string()).combine_chunks() if not isinstance(v, pa.Array) else v.cast(pa.string()) for v in values] if values else [pa.nulls(n, pa.string())] * 2
                parts.append(pa.table([*[c.combine_chunks() for c in got.columns], pa.array([field] * n, pa.string()), *text], names=[*key_list, "field_name", "left_value", "right_value"]))

        emit(x, np.flatnonzero(to_y < 0), only_left, None)
        emit(y, np.flatnonzero(to_x < 0), only_right, None)
        both = np.flatnonzero(to_y >= 0)
        if len(both):
            u, v = x.take(pa.array(both)), y.take(pa.array(to_y[both]))
            for f in names:
                mask = _differs(u[f], v[f], tolerance)
                rows = np.flatnonzero(mask)
                if len(rows):
                    emit(u, rows, f, (u[f].take(pa.array(rows)), v[f].take(pa.array(rows))))
        if not parts:
            return pa.table({**{k: x[k].combine_chunks()[:0] for k in key_list}, **{c: pa.nulls(0, pa.string()) for c in ("field_name", "left_value", "right_value")}})
        return pa.concat_tables(parts)

    by = F.pmod(F.col("_hash"), F.lit(buckets)).alias("_bucket")
    return a.groupBy(by).cogroup(b.groupBy(by)).applyInArrow(compare, schema)
