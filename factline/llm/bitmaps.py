"""A broadcast membership sketch over a distributed set of keys, as large as the set asks for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.words import Bitmap

_PAGE = 15  # log2 of the bits that one bitmap_construct_agg buffer holds


def bitmap_of(keys: DataFrame, count: int) -> np.ndarray:
    """The bytes of a Bitmap of the `count` 64-bit keys in keys' one column.

    Bits go to the task that owns their page and are set there, on the JVM; the driver gets the
    finished pages, two to four bytes a key, and 128 MB at most (from 2^26 keys on the bitmap
    lets more through than it would). The result only spares work: whoever asks it must check what
    it lets through.
    """
    bits = Bitmap.bits_for(count)
    name = f"`{keys.columns[0]}`"
    mask = (1 << bits) - 1
    probes = ", ".join(f"(({name} & {mask}L) + {k}L * (shiftrightunsigned({name}, 34) | 1L)) & {mask}L" for k in range(Bitmap.PROBES))
    places = keys.select(F.explode(F.expr(f"array({probes})")).alias("p"))
    pages = places.select(F.shiftright("p", _PAGE).alias("page"), F.col("p").bitwiseAND(F.lit((1 << _PAGE) - 1)).alias("bit")).repartition("page")
    whole = Bitmap.empty(bits)
    at = whole.data.reshape(-1, 1 << (_PAGE - 3))
    for row in pages.groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).toLocalIterator():
        at[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.data
