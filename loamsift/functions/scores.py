"""Score vectors as native array expressions, plus rounding and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamsift import fixed


def round1(c: Column) -> Column:
    """One decimal, half to even."""
    return F.bround(c, 1)


def mean1(c: Column | str) -> Column:
    """Mean with one decimal, summed as decimals: the same for any order of the rows."""
    c = F.col(c) if isinstance(c, str) else c
    return round1(F.avg(c.cast("decimal(18,6)"))).cast("double")


def softmax(logits: Column) -> Column:
    """Stable softmax of an array column."""
    as_double = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(as_double)
    exps = F.transform(as_double, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def argmax(p: Column) -> Column:
    """Zero-based index of the first maximum."""
    return F.array_position(p, F.array_max(p)) - 1


def label_array(labels: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def percent_map(p: Column, labels: tuple[str, ...]) -> Column:
    """label -> percent with one decimal."""
    return F.map_from_arrays(label_array(labels), F.transform(p, lambda x: round1(x * 100)))


def score_columns(confidences: Column, labels: tuple[str, ...]) -> dict[str, Column]:
    """One ``score_<label>`` column per label, 0 where the map has none."""
    return {f"score_{x}": F.coalesce(F.element_at(confidences, F.lit(x)), F.lit(0.0))
            for x in labels}


def label_color(label: Column, labels: tuple[str, ...]) -> Column:
    """Palette colour by label position, grey for an unknown label."""
    pairs = []
    for i, name in enumerate(labels):
        pairs += [F.lit(name), F.lit(fixed.PALETTE[i % len(fixed.PALETTE)])]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit(fixed.DEFAULT_COLOR))


def encode_label(label: Column, ids: dict[str, int]) -> Column:
    pairs = [F.lit(v) for kv in ids.items() for v in kv]
    return F.element_at(F.create_map(*pairs), label)


def decode_label(label_id: Column, names: dict[str, str]) -> Column:
    """Look an id up in a config whose keys are the ids as text."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.element_at(F.create_map(*pairs), label_id.cast("string"))


def share_bar(pct: Column) -> Column:
    """One block per full two percent."""
    return F.repeat(F.lit("█"), F.floor(pct / 2).cast("int"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent_text(pct: Column) -> Column:
    return F.format_string("%.1f%%", pct)


def iso_timestamp(ts: Column) -> Column:
    """ISO text with microseconds, without them when they are zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def batch_id() -> Column:
    """Short random id. Take it once per batch, not per row."""
    return F.left(F.uuid(), F.lit(8))
