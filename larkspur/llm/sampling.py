"""Bounded training samples: the only place where rows are sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1_000_000_000


def kept_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def piece(text: Column, key: Column, chars: int) -> Column:
    """A passage of up to ``chars`` characters that starts at a place drawn from the key's hash."""
    return F.substring(text, (F.pmod(F.xxhash64(key, F.lit("place")), F.greatest(F.length(text) - chars + 1, F.lit(1))) + 1).cast("int"), F.lit(chars))


def class_sample(rows: DataFrame, label: str, key: str, per_class: int) -> tuple[DataFrame, dict]:
    """Rows of a hash sample with about ``per_class`` rows of each label, and the label counts over all rows.

    The counts are map-side combined and must be few, as labels are; the sample
    is a filter, so nothing is moved for it.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).collect()}
    if not counts:
        return rows.limit(0), counts
    share = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, min(SCALE, int(SCALE * 1.2 * per_class / n) + 1))])
    return rows.where(F.pmod(F.xxhash64(key), F.lit(SCALE)) < share[F.col(label)]), counts
