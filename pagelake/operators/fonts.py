"""Fonts as joins: nearest faces, text widths, kerning and line metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..kernels.font import GENERIC, TALLER


def nearest_face(wanted: DataFrame, faces: DataFrame) -> DataFrame:
    """wanted (request_id, family, weight, italic) with the face of its family nearest in style, then weight: up to 500 lighter faces come first, above heavier ones."""
    generic = F.create_map(*[F.lit(x) for kv in GENERIC.items() for x in kv])
    w = wanted.select("request_id", F.lower(F.coalesce(F.element_at(generic, F.lower("family")), F.col("family"))).alias("_family"), "weight", "italic")
    f = faces.select(F.lower("family").alias("_family"), F.col("weight").alias("_w"), F.col("italic").alias("_i"), "face_id")
    d = F.col("_w") - F.col("weight")
    wrong = F.when(F.col("weight") <= 500, d > 0).otherwise(d < 0)
    rank = F.struct((F.col("_i") != F.col("italic")).alias("style"), (F.abs(d) + F.when(wrong, 1000).otherwise(0)).alias("distance"), F.col("face_id").alias("id"))
    return w.join(f, "_family").groupBy("request_id").agg(F.min_by("face_id", rank).alias("face_id"))


def glyphs(texts: DataFrame, cmap: DataFrame) -> DataFrame:
    """(text_id, face_id, pos, glyph) of texts (text_id, face_id, text) by cmap (face_id, code, glyph); 0 where a face has no glyph."""
    chars = texts.select("text_id", "face_id", F.posexplode(F.split("text", "")).alias("pos", "_c")).where("_c != ''").withColumn("code", F.ascii("_c"))
    return chars.join(cmap, ["face_id", "code"], "left").select("text_id", "face_id", "pos", F.coalesce("glyph", F.lit(0)).alias("glyph"))


def text_widths(glyph_rows: DataFrame, advances: DataFrame, kerning: DataFrame | None = None) -> DataFrame:
    """(text_id, face_id, units): summed advances (face_id, glyph, advance), with kerning (face_id, left, right, value) to the next glyph if given."""
    w = Window.partitionBy("text_id", "face_id").orderBy("pos")
    rows = glyph_rows.withColumn("_next", F.lead("glyph").over(w)).join(advances, ["face_id", "glyph"], "left")
    units = F.coalesce("advance", F.lit(0))
    if kerning is not None:
        k = kerning.select("face_id", F.col("left").alias("glyph"), F.col("right").alias("_next"), "value")
        rows = rows.join(k, ["face_id", "glyph", "_next"], "left")
        units = units + F.coalesce("value", F.lit(0))
    return rows.groupBy("text_id", "face_id").agg(F.sum(units).cast("long").alias("units"))


def line_metrics(family: Column, ascender: Column, descender: Column, line_gap: Column, units_per_em: Column, size: Column) -> Column:
    """Struct (ascent, descent, gap) in whole px; round() takes halves away from zero."""
    px = lambda c: F.round(c * size / units_per_em)
    up, down = px(ascender), px(-descender)
    taller = F.when(family.isin(*TALLER), F.floor((up + down) * 0.15 + 0.5)).otherwise(0)
    return F.struct((up + taller).cast("double").alias("ascent"), down.cast("double").alias("descent"), px(line_gap).cast("double").alias("gap"))
