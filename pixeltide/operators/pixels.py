"""Point, colour and coordinate transforms of pixel tables (frame_id, y, x, c, v); c is 0 blue, 1 green, 2 red.

All but those that need a frame's histogram or all channels of a pixel are projections without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixeltide.operators.params import clamp, saturate, small_table

AT = ["frame_id", "y", "x"]


def frames_to_pixels(frames: DataFrame) -> DataFrame:
    """One row per value of frames(frame_id, height, width, channels, data array, row by row, channels innermost)."""
    px = frames.select("frame_id", "width", "channels", F.posexplode("data").alias("pos", "v"))
    row = F.col("width") * F.col("channels")
    return px.select(
        "frame_id",
        F.floor(F.col("pos") / row).cast("int").alias("y"),
        F.floor(F.col("pos") / F.col("channels") % F.col("width")).cast("int").alias("x"),
        (F.col("pos") % F.col("channels")).cast("int").alias("c"),
        "v",
    )


def pixels_to_frames(px: DataFrame) -> DataFrame:
    """The inverse. A frame is one row, so its pixels meet in one task: a frame's size bounds the group."""
    return px.groupBy("frame_id").agg(
        (F.max("y") + 1).alias("height"),
        (F.max("x") + 1).alias("width"),
        (F.max("c") + 1).alias("channels"),
        F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "c", "v"))), lambda p: p["v"]).alias("data"),
    )


def channels(px: DataFrame) -> DataFrame:
    """frame_id, y, x, b, g, r."""
    return px.groupBy(*AT).agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate("bgr")])


def spread(wide: DataFrame, names=("b", "g", "r")) -> DataFrame:
    """Back to one row per channel."""
    rows = F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("int").alias("v")) for i, n in enumerate(names)])
    return wide.select(*AT, F.inline(rows))


def gray_of(b: Column, g: Column, r: Column) -> Column:
    return F.shiftright(9798 * r + 19235 * g + 3735 * b + 16384, 15)


def grayscale(px: DataFrame) -> DataFrame:
    """Luma in three equal channels."""
    wide = channels(px).withColumn("gray", gray_of(F.col("b"), F.col("g"), F.col("r")))
    return spread(wide, ("gray", "gray", "gray"))


def grayscale_frames(frames: DataFrame) -> DataFrame:
    """The same on packed three-channel frames: a projection."""
    d = F.col("data")
    at = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    gray = F.transform(at, lambda i: gray_of(d[i * 3], d[i * 3 + 1], d[i * 3 + 2]))
    return frames.withColumn("data", F.flatten(F.transform(gray, lambda g: F.array(g, g, g))))


def brightness(px: DataFrame, beta: int) -> DataFrame:
    beta = clamp(beta, 0, 255)
    return px.withColumn("v", F.least(F.lit(255), F.abs(F.col("v") + beta)).cast("int"))


def contrast(px: DataFrame, alpha: float) -> DataFrame:
    alpha = clamp(alpha, 0.0, 4.0, 3)
    return px.withColumn("v", saturate(F.abs(F.col("v") * F.lit(alpha))))


def gamma_table(g: float) -> list[int]:
    """The 256 values v -> (v / 255) ** g * 255, cut to whole numbers."""
    g = clamp(g, 0.01, 4.0, 3)
    return [int(min(255.0, max(0.0, (i / 255) ** g * 255))) for i in range(256)]


def map_values(px: DataFrame, values: list[int]) -> DataFrame:
    lut = small_table(px.sparkSession, list(enumerate(values)), "v int, new int")
    return px.join(lut, "v").select(*AT, "c", F.col("new").alias("v"))


def gamma(px: DataFrame, g: float) -> DataFrame:
    return map_values(px, gamma_table(g))


KINDS = ("binary", "binary_inv", "trunc", "tozero", "tozero_inv")


def threshold(px: DataFrame, kind: str, t: int = 127) -> DataFrame:
    """Values over t and the rest, by kind."""
    return px.withColumn("v", _cut(kind, F.lit(clamp(t, 0, 255))).cast("int"))


def _cut(kind: str, t: Column) -> Column:
    v = F.col("v")
    over, under = {"binary": (255, 0), "binary_inv": (0, 255), "trunc": (t, v), "tozero": (v, 0), "tozero_inv": (0, v)}[kind]
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(v > t, wrap(over)).otherwise(wrap(under))


def otsu_thresholds(px: DataFrame) -> DataFrame:
    """frame_id, t: the threshold with the largest variance between the two sides (the lowest on ties)."""
    hist = px.groupBy("frame_id", "v").agg(F.count("*").alias("n"))
    below = Window.partitionBy("frame_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("frame_id")
    h = hist.select("frame_id", "v", F.sum("n").over(below).alias("w"), F.sum(F.col("n") * F.col("v")).over(below).alias("s"), F.sum("n").over(whole).alias("nn"), F.sum(F.col("n") * F.col("v")).over(whole).alias("ss"))
    h = h.where("w < nn")
    # between-class variance over nn^2 is (s*nn - ss*w)^2 / (w*(nn-w)): whole numbers until the one division
    d = (F.col("s") * F.col("nn") - F.col("ss") * F.col("w")).cast("double")
    h = h.withColumn("var", d * d / (F.col("w") * (F.col("nn") - F.col("w"))))
    best = h.groupBy("frame_id").agg(F.max(F.struct("var", (-F.col("v")).alias("k"))).alias("x"))
    flat = px.groupBy("frame_id").agg(F.min("v").alias("lo"))
    return flat.join(best, "frame_id", "left").select("frame_id", F.coalesce(-F.col("x.k"), "lo").alias("t"))


def otsu(px: DataFrame) -> DataFrame:
    t = otsu_thresholds(px)
    return px.join(t, "frame_id").withColumn("v", F.when(F.col("v") > F.col("t"), 255).otherwise(0)).drop("t")


def trigger_count(px: DataFrame, t: int = 127, n: int = 1) -> DataFrame:
    """frame_id, n_over (values over t), fired (n or more)."""
    return px.groupBy("frame_id").agg(F.count(F.when(F.col("v") > clamp(t, 0, 255), 1)).alias("n_over")).withColumn("fired", F.col("n_over") >= n)


def palette(name: str) -> list[tuple[int, int, int, int]]:
    """(v, b, g, r) of a closed-form palette."""
    out = []
    for v in range(256):
        x = v / 255
        ramp = lambda a: min(1.0, max(0.0, a))
        b, g, r = {
            "autumn": (0, x, 1),
            "winter": (1 - x / 2, x, 0),
            "summer": (0.4, 0.5 + x / 2, x),
            "spring": (1 - x, x, 1),
            "cool": (1, 1 - x, x),
            "hot": (ramp((x - 2 / 3) * 3), ramp((x - 1 / 3) * 3), ramp(x * 3)),
            "jet": (ramp(1.5 - abs(4 * x - 1)), ramp(1.5 - abs(4 * x - 2)), ramp(1.5 - abs(4 * x - 3))),
            "hsv": tuple(ramp(abs((x * 6 + k) % 6 - 3) - 1) for k in (2, 4, 0)),
        }[name]
        out.append((v, *[int(round(c * 255)) for c in (b, g, r)]))
    return out


def apply_colormap(px: DataFrame, lut: DataFrame) -> DataFrame:
    """Gray values through a palette table (v, b, g, r)."""
    return spread(px.join(lut, "v"))


def bgr_to_hsv(px: DataFrame) -> DataFrame:
    """Hue in halves of a degree (0..179), saturation and value 0..255, as channels 0, 1, 2."""
    w = channels(px)
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    v = F.greatest(b, g, r)
    d = v - F.least(b, g, r)
    hue = F.when(d == 0, 0.0).when(v == r, (g - b) * 30 / d).when(v == g, (b - r) * 30 / d + 60).otherwise((r - g) * 30 / d + 120)
    hue = F.bround(F.when(hue < 0, hue + 180).otherwise(hue), 0).cast("int") % 180
    sat = F.when(v == 0, 0).otherwise(F.bround(d * 255 / v, 0).cast("int"))
    return spread(w.select(*AT, hue.alias("h"), sat.alias("s"), v.alias("v")), ("h", "s", "v"))


def hsv_to_bgr(px: DataFrame) -> DataFrame:
    w = px.groupBy(*AT).agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate("hsv")])
    h, s, v = F.col("h") / 30, F.col("s") / 255, F.col("v")

    def part(n):
        k = F.pmod(F.lit(n) + h, F.lit(6.0))
        return saturate(v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))

    return spread(w.select(*AT, part(1.0).alias("b"), part(3.0).alias("g"), part(5.0).alias("r")))


def equalize(px: DataFrame, channel: int | None = None) -> DataFrame:
    """Histogram equalisation of one channel per frame (all rows if None)."""
    own = px if channel is None else px.where(F.col("c") == channel)
    hist = own.groupBy("frame_id", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("frame_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("frame_id")
    cdf = hist.select("frame_id", "v", F.sum("n").over(up).alias("cdf"), F.sum("n").over(whole).alias("nn"))
    cdf = cdf.withColumn("least", F.min("cdf").over(whole))
    span = F.col("nn") - F.col("least")
    new = F.when(span == 0, F.col("v")).otherwise(F.bround((F.col("cdf") - F.col("least")) * 255 / span, 0).cast("int"))
    done = own.join(cdf.select("frame_id", "v", new.alias("new")), ["frame_id", "v"]).select(*AT, "c", F.col("new").alias("v"))
    return done if channel is None else done.unionByName(px.where(F.col("c") != channel))


def equalize_hist(px: DataFrame) -> DataFrame:
    """Equalises brightness; hue and saturation stay."""
    return hsv_to_bgr(equalize(bgr_to_hsv(px), 2))


#: Fixed values of the public ImageNet statistics, by channel red, green, blue.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalize(px: DataFrame, mode: str, rgb: bool = True) -> DataFrame:
    """Model inputs: unit (v/255), signed (v/127.5-1), imagenet, raw; rgb puts red first."""
    v = F.col("v")
    out_c = (2 - F.col("c")) if rgb else F.col("c")

    def pick(values):
        return F.when(F.col("c") == 2, values[0]).when(F.col("c") == 1, values[1]).otherwise(values[2])

    new = {"unit": v / 255.0, "signed": v / 127.5 - 1.0, "imagenet": (v / 255.0 - pick(MEAN)) / pick(STD), "raw": v.cast("double")}[mode]
    return px.select("frame_id", "y", "x", out_c.cast("int").alias("c"), new.alias("v"))


def tensor(px: DataFrame) -> DataFrame:
    """frame_id, data: values channel by channel, row by row."""
    return px.groupBy("frame_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "y", "x", "v"))), lambda p: p["v"]).alias("data"))


def denormalize(px: DataFrame, clip: bool = True, rgb: bool = True, first: int = 0) -> DataFrame:
    """Model outputs in 0..1 to pixel values cut to whole numbers; channels first..first+2; clip=False wraps."""
    px = px.where(F.col("c").between(first, first + 2))
    v = F.col("v") * 255.0
    new = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v))) if clip else F.pmod(F.floor(v), F.lit(256))
    c = F.col("c") - first
    return px.select("frame_id", "y", "x", ((2 - c) if rgb else c).cast("int").alias("c"), new.cast("int").alias("v"))


def crop(px: DataFrame, x0: float, x1: float, y0: float, y1: float, width: int, height: int) -> DataFrame:
    """The part between fractions of the sides, from its own origin; bounds that cross are set 0.01 apart."""
    x0, x1, y0, y1 = (clamp(v, 0.0, 1.0, 3) for v in (x0, x1, y0, y1))
    if x0 > x1:
        x0 = x1 - 0.01
    if y0 > y1:
        y0 = y1 - 0.01
    left, right, top, bottom = int(max(0.0, x0) * width), int(x1 * width), int(max(0.0, y0) * height), int(y1 * height)
    inside = (F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom)
    return px.where(inside).withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def flip(px: DataFrame, horizontal: bool, vertical: bool, width: int, height: int) -> DataFrame:
    if horizontal:
        px = px.withColumn("x", width - 1 - F.col("x"))
    return px.withColumn("y", height - 1 - F.col("y")) if vertical else px
