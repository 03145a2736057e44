"""Row-level expressions: buckets, guards, repairs, parsing, normalising and keys.

Everything here is a built-in expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """First matching rule wins."""
    out = F
    for condition, label in rules:
        out = out.when(condition, label)
    return out.otherwise(default)


def steps(c: str | Column, edges: Sequence[tuple[float, str]], default: str) -> Column:
    """Bucket by rising upper bounds (exclusive)."""
    return bucket([(_col(c) < edge, label) for edge, label in edges], default)


def rank_of(c: str | Column, labels: Sequence[str]) -> Column:
    """Position of a label in a custom order; unknown labels come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), _col(c))
    return F.when(place > 0, place).otherwise(len(labels) + 1).cast("int")


def order_by_rank(df: DataFrame, c: str, labels: Sequence[str]) -> DataFrame:
    return df.orderBy(rank_of(c, labels), c)


def safe_divide(num: str | Column, den: str | Column, default: float | None = None) -> Column:
    """``num / den`` where ``den`` is positive or negative; ``default`` where it is zero or NULL."""
    num, den = _col(num), _col(den)
    return F.when(den != 0, num / den).otherwise(F.lit(default))


def any_of(rules: Sequence[Column]) -> Column:
    """True when at least one rule holds; an unknown rule counts as not holding."""
    return reduce(or_, [F.coalesce(r, F.lit(False)) for r in rules])


def touches(columns: Sequence[str], keys: Sequence[int]) -> Column:
    """Any of the columns is in the key set."""
    return any_of([F.col(c).isin(*keys) for c in columns])


def direction(origin: str, target: str, keys: Sequence[int]) -> Column:
    """'From' when the origin is a key, else 'To' when the target is, else NULL."""
    return bucket([(F.col(origin).isin(*keys), "From"), (F.col(target).isin(*keys), "To")], None)


def fill(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a constant per column, keeping each column's type."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items()}
    )


def recode(c: str | Column, sentinels: Sequence[object], value: object) -> Column:
    """NULL and sentinel codes become ``value``."""
    c = _col(c)
    return F.when(c.isNull() | c.isin(*sentinels), F.lit(value)).otherwise(c)


def clamp(c: str | Column, low: object = None, high: object = None) -> Column:
    """Cap below and above; NULL stays NULL (``least``/``greatest`` alone would drop it)."""
    c = _col(c)
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    return out


def parse_any(c: str | Column, formats: Sequence[str]) -> Column:
    """First format that parses; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats])


def normalise(c: str | Column, mapping: Mapping[str, str], default: str) -> Column:
    """Trim, lower-case, look up, else ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    key = F.lower(F.trim(_col(c)))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def matches(c: str | Column, pattern: str, full: bool = True) -> Column:
    """Full match, or match from the start of the value with ``full=False``."""
    return _col(c).cast("string").rlike(f"^(?:{pattern})" + ("$" if full else ""))


def hash_key(columns: Sequence[str | Column]) -> Column:
    """Null-safe digest of several columns.

    Each part is preceded by its length, and a null is a mark of its own, so neither ('a~b', 'c') and
    ('a', 'b~c') nor null and '' share a key.
    """
    texts = [_col(c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.md5(F.concat(*parts))


def tagged_key(tag: str | Column, *columns: str) -> Column:
    """Readable composed key: tag, then the columns, joined by '-'."""
    head = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat_ws("-", head, *[F.col(c).cast("string") for c in columns])
