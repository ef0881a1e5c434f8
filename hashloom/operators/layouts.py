"""Layouts of images as grids of patch vectors: moved, turned, covered in part, or with grain; each seeded by the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patches of a side of the grid, and those the eye rests on.
SIDE, CENTRE = 4, (5, 6, 9, 10)


def digit(seed: Column, place: int) -> Column:
    """Hex digit of the seed's MD5 at a place (from 1), as a number."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(seed), place, 1)) - 1


def _seed(image: Column, kind: str) -> Column:
    return F.concat(image.cast("string"), F.lit(f":{kind}"))


def shifted(image: Column, patch: Column) -> Column:
    """Where a patch goes when its image moves by 1 to 3 columns and 0 to 3 rows; what leaves at one side enters at the other."""
    across, down = 1 + digit(_seed(image, "shift"), 1) % 3, digit(_seed(image, "shift"), 2) % SIDE
    row, column = F.floor(patch / SIDE), patch % SIDE
    return ((row + down) % SIDE) * SIDE + (column + across) % SIDE


def turned(image: Column, patch: Column) -> Column:
    """Where a patch goes when its image is turned right by 1 to 3 quarters."""
    quarters, last = 1 + digit(_seed(image, "rotation"), 1) % 3, SIDE - 1
    row, column = F.floor(patch / SIDE), patch % SIDE
    return F.when(quarters == 1, column * SIDE + last - row).when(quarters == 2, (last - row) * SIDE + last - column).otherwise((last - column) * SIDE + row)


def covered(image: Column, patch: Column) -> Column:
    """Whether a patch lies in the image's covered square of 2 by 2."""
    row, column = F.floor(patch / SIDE), patch % SIDE
    down, across = (row - digit(_seed(image, "occlusion"), k) % 3 if k == 1 else column - digit(_seed(image, "occlusion"), k) % 3 for k in (1, 2))
    return down.between(0, 1) & across.between(0, 1)


def grained(vector: Column, image: Column, patch: Column) -> Column:
    """The vector with a sixteenth of its values at 1 and a sixteenth at -1: salt and pepper."""

    def grain(x: Column, i: Column) -> Column:
        d = digit(F.concat_ws(":", image.cast("string"), patch.cast("string"), i.cast("string")), 1)
        return F.when(d == 0, F.lit(1.0)).when(d == 15, F.lit(-1.0)).otherwise(x)

    return F.transform(vector, grain)


def layouts(patches: DataFrame) -> DataFrame:
    """(image, patch, vector: array<double>) -> image, layout, patch (its new place), vector, weight: each image in five layouts.

    centre: as it is; shift and rotation: patches change places; occlusion: some vectors become zeros; grain: values do.
    Nothing is shuffled: a patch's part in a layout follows from its image's seed. A null vector stays null.
    """
    image, patch, vector = F.col("image"), F.col("patch"), F.col("vector")
    one = lambda name, place, v: F.struct(F.lit(name).alias("layout"), place.cast("long").alias("place"), v.alias("v"))
    every = F.array(
        one("centre", patch, vector),
        one("shift", shifted(image, patch), vector),
        one("rotation", turned(image, patch), vector),
        one("occlusion", patch, F.when(covered(image, patch), F.transform(vector, lambda x: F.lit(0.0))).otherwise(vector)),
        one("grain", patch, grained(vector, image, patch)),
    )
    out = patches.select("image", F.explode(every).alias("_x")).select("image", "_x.layout", F.col("_x.place").alias("patch"), F.col("_x.v").alias("vector"))
    return out.withColumn("weight", F.when(F.col("patch").isin(*CENTRE), F.lit(1.5)).otherwise(F.lit(0.8)))
