"""String and array functions: natural order, channel names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Sorts digits by value and letters without case: each run of digits is padded to one width."""
    return F.concat_ws("", F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)")), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)))


def channel_names(names: Column, n: Column) -> Column:
    """The names if there are as many as channels, else C0, C1, ..."""
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.lit("C"), k.cast("string")))
    return F.when(F.size(names) == n, names).otherwise(made)


def merged_name(image: Column, channel: Column) -> Column:
    return F.concat_ws(" - ", image, channel)


def merge_names(images: list[str], channels: list[list[str]]) -> list[str]:
    """The channels of several images in order, each after its image's name."""
    return [f"{image} - {name}" for image, names in zip(images, channels, strict=True) for name in names]


def hop_label(hop: Column, target: Column) -> Column:
    """NNN-to-target, as hops are named in saved transforms."""
    return F.concat(F.lpad(hop.cast("string"), 3, "0"), F.lit("-to-"), target)


def is_rgb(shape: Column) -> Column:
    return (F.size(shape) > 2) & (F.element_at(shape, -1) < 5)
