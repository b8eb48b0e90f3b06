"""Pixel operators over tables (image_id, channel, y, x, v): intensity scalars, projections, spatial steps, pyramids.

Each is a function DataFrame -> DataFrame made of built-in expressions. Only those that look at a whole image (rescaling, boxes,
pyramids) shuffle, and they combine within each task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of red, green and blue in a grey value, and the gain and offset of contrast enhancement.
GREY = (0.2125, 0.7154, 0.0721)
GAIN, OFFSET = 7, 1
UNSIGNED = (("uint8", 255), ("uint16", 65535), ("int32", 4294967295))


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Each weighted term is cut to an integer before they are added."""
    return sum((F.floor(c * F.lit(w)) for c, w in zip((r, g, b), GREY, strict=True)), F.lit(0)).cast("long")


def grayscale_image(pixels: DataFrame) -> DataFrame:
    """The first three channels of each pixel as one grey channel."""
    wide = pixels.filter(F.col("channel") < 3).groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("channel") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")])
    return wide.select("image_id", F.lit(0).alias("channel"), "y", "x", grayscale(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("v"))


def contrast(v: Column) -> Column:
    return F.least(F.lit(255.0), F.abs(v * GAIN + OFFSET))


def invert(v: Column, most: float = 255.0) -> Column:
    return F.lit(most) - v


def rescale(pixels: DataFrame, keys: tuple[str, ...] = ("image_id", "channel")) -> DataFrame:
    """v to 0..255 by the least and largest value of each group, cut to integers; a constant image becomes 0."""
    ends = pixels.groupBy(*keys).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("v") - F.col("_low")) * 255.0 / (F.col("_high") - F.col("_low")))).otherwise(0)
    return pixels.join(ends, list(keys)).withColumn("v", scaled.cast("double")).select(*pixels.columns)


def max_projection(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "y", "x").agg(F.max("v").alias("v")).select("image_id", F.lit(0).alias("channel"), "y", "x", "v")


def select_channels(pixels: DataFrame, indices: list[int]) -> DataFrame:
    """Channels in the order of the list, numbered anew."""
    place = F.array_position(F.array(*[F.lit(k) for k in indices]), F.col("channel").cast("int")) - 1
    return pixels.filter(F.col("channel").isin(indices)).withColumn("channel", place.cast("int"))


def single_channel(pixels: DataFrame, channel: int) -> DataFrame:
    """One channel of each image; 0 where it has no such channel."""
    count = pixels.groupBy("image_id").agg((F.max("channel") + 1).alias("_n"))
    return pixels.join(count, "image_id").filter(F.col("channel") == F.when(F.lit(channel) < F.col("_n"), F.lit(channel)).otherwise(0)).drop("_n")


def as_uint8(v: Column) -> Column:
    """Sixteen bits to eight by division, the other mode beside rescale()."""
    return F.floor(v / 256)


def threshold_mask(v: Column) -> Column:
    return F.when(v >= 1, 1).otherwise(0)


def whole(pixels: DataFrame, w: int, h: int) -> DataFrame:
    """Pixels of one channel of an image with a corner of 0 where the last pixel of its size isn't there, so that its extent is known."""
    corner = pixels.sparkSession.createDataFrame([(h - 1, w - 1)], "y long, x long").join(pixels.select("y", "x"), ["y", "x"], "left_anti")
    named = pixels.select("image_id", "channel").limit(1)
    return pixels.unionByName(corner.join(named).select("image_id", "channel", "y", "x", F.lit(0.0).alias("v")))


def shrink(pixels: DataFrame, k: int) -> DataFrame:
    """Every k-th pixel from the first; the size is cut to whole steps."""
    size = pixels.groupBy("image_id").agg(F.floor((F.max("y") + 1) / k).alias("_h"), F.floor((F.max("x") + 1) / k).alias("_w")) if k > 1 else None
    if size is None:
        return pixels
    kept = pixels.filter((F.col("y") % k == 0) & (F.col("x") % k == 0)).withColumn("y", F.floor(F.col("y") / k)).withColumn("x", F.floor(F.col("x") / k))
    return kept.join(size, "image_id").filter((F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w"))).select(*pixels.columns)


def flip(pixels: DataFrame, axis: str, w: int, h: int) -> DataFrame:
    return pixels.withColumn("x", F.lit(w - 1) - F.col("x")) if axis == "h" else pixels.withColumn("y", F.lit(h - 1) - F.col("y"))


def rotate90(pixels: DataFrame, w: int) -> DataFrame:
    """A quarter turn against the clock: the last column becomes the first row."""
    return pixels.withColumns({"y": F.lit(w - 1) - F.col("x"), "x": F.col("y")})


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The filter reaches the scan; what is left is moved to the corner."""
    inside = pixels.filter((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    return inside.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def mask_box(mask: DataFrame, pad: int = 100) -> DataFrame:
    """(image_id, x, y, w, h) of the foreground, padded and held within the image. Boxes of its parts have the same union, so they aren't told apart."""
    fore = F.col("v") >= 1
    ends = mask.groupBy("image_id").agg(
        F.max("x").alias("mx"), F.max("y").alias("my"), F.min(F.when(fore, F.col("x"))).alias("x0"), F.min(F.when(fore, F.col("y"))).alias("y0"), F.max(F.when(fore, F.col("x"))).alias("x1"), F.max(F.when(fore, F.col("y"))).alias("y1")
    ).filter("x0 is not null")
    left, top = F.greatest(F.col("x0") - pad, F.lit(0)), F.greatest(F.col("y0") - pad, F.lit(0))
    right, bottom = F.least(F.col("x1") + 1 + pad, F.col("mx") + 1), F.least(F.col("y1") + 1 + pad, F.col("my") + 1)
    return ends.select("image_id", left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def pyramid_level(pixels: DataFrame, level: int, w: int, h: int) -> DataFrame:
    """Means of blocks of 2**level pixels of the base image, cut to integers; what fills no block is left out."""
    f = 1 << level
    whole = pixels.filter((F.col("y") < h // f * f) & (F.col("x") < w // f * f))
    block = whole.groupBy("image_id", "channel", F.floor(F.col("y") / f).alias("y"), F.floor(F.col("x") / f).alias("x"))
    return block.agg(F.floor(F.round(F.avg("v"), 9)).cast("double").alias("v"))


def pyramid_sizes(w: int, h: int, tile: int) -> list[tuple[int, int]]:
    """Sizes (x, y) of the levels: halved while all sides are over the tile, and the last entry dropped; one at least."""
    sizes = [(w, h)]
    while all(n > tile for n in sizes[-1]):
        sizes.append(tuple(n // 2 for n in sizes[-1]))
    return sizes[:-1] if len(sizes) > 1 else sizes


def pyramid_table(sizes: DataFrame, tile: int, most: int = 40) -> DataFrame:
    """pyramid_sizes() of a table of images with columns w and h: a row for each image and level, with the level's w and h."""
    at = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2), level))
    # a level is there if it is over the tile, as each one before it then is too
    kept = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: (k == 0) | (F.least(at("w", k), at("h", k)) > tile))
    each = sizes.withColumn("level", F.explode(kept))
    return each.withColumns({"w": at("w", F.col("level")), "h": at("h", F.col("level"))})


def narrowest(most: Column) -> Column:
    """The name of the smallest integer type that holds values up to `most`."""
    out = F.when(most <= UNSIGNED[0][1], UNSIGNED[0][0])
    for name, top in UNSIGNED[1:]:
        out = out.when(most <= top, name)
    return out


# --- two images together


def joint_histogram(pairs: DataFrame, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of (a, b) in bins of the value range 0..1; pairs has columns a and b."""
    bin_ = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    return pairs.select(*keys, bin_("a").alias("a"), bin_("b").alias("b")).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


def mutual_information(histogram: DataFrame) -> DataFrame:
    """In nats. The histogram is of fixed size, so its margins are joined back to it."""
    a = histogram.groupBy("a").agg(F.sum("n").alias("na"))
    b = histogram.groupBy("b").agg(F.sum("n").alias("nb"))
    total = histogram.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    joined = histogram.join(a, "a").join(b, "b").crossJoin(F.broadcast(total))
    return joined.agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))


def mean_squares(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("msq"))


def normalised_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.corr("a", "b").alias("ncc"))


def dice(pairs: DataFrame) -> DataFrame:
    """Twice the common foreground over both foregrounds; pairs has masks a and b."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col("a") >= 1, F.col("b") >= 1
    return pairs.agg((2.0 * one(a & b) / F.nullif(one(a) + one(b), F.lit(0))).alias("dice"))


def merge_channels(images: list[tuple[str, DataFrame]]) -> DataFrame:
    """All channels of several images as those of one, in order; each image's channels are counted on from those before."""
    out, before = None, 0
    for name, df in images:
        n = df.agg(F.max("channel")).first()[0]
        moved = df.select(F.lit("merged").alias("image_id"), (F.col("channel") + before).cast("int").alias("channel"), "y", "x", "v", F.lit(name).alias("source"))
        out = moved if out is None else out.unionByName(moved)
        before += (n if n is not None else -1) + 1
    return out
