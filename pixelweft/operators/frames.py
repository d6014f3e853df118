"""Animations: frames drawn one after another on a canvas, as their rules of blending and disposal say.

Frames are images of four bands (the fourth is alpha) placed by a table frames(anim, frame, image_id, left_, top_, dispose, blend):
frame numbers go up from 0, dispose is none, background or previous, blend is source or over. Each place of a canvas folds the frames
that cover it in their order, and a window carries what was left by the last of them to the frames that do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bands as they are named in the fold.
RGBA = ("r", "g", "b", "a")


def _shown(now: str, new: str) -> str:
    """A pixel drawn on the canvas, in whole numbers: replaced, left, or laid over by alpha."""
    rest = f"(255 - {new}.a)"
    alpha = f"({new}.a + ({now}.a * {rest} + 127) div 255)"
    mixed = ", ".join(f"'{c}', least(255L, ({new}.{c} * {new}.a + ({now}.{c} * {now}.a * {rest}) div 255 + {alpha} div 2) div {alpha})" for c in "rgb")
    same = lambda x: ", ".join(f"'{c}', {x}.{c}" for c in RGBA)
    return (f"CASE WHEN {new}.blend = 'source' OR {new}.a = 255 THEN named_struct({same(new)}) WHEN {new}.a = 0 THEN named_struct({same(now)}) "
            f"ELSE named_struct({mixed}, 'a', {alpha}) END")


def composed(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """(anim, frame, x, y, band, v): what each frame of each animation shows, on a canvas that reaches to the farthest pixel of its frames.

    The canvas is transparent (0) at first. After a frame is shown its place is left, cleared (background) or put back as it
    was before (previous). A missing alpha band counts as opaque.
    """
    wide = pixels.groupBy("image_id", "x", "y").agg(*(F.max(F.when(F.col("band") == k, F.col("v"))).alias(c) for k, c in enumerate(RGBA)))
    placed = wide.join(frames, "image_id").select(
        "anim", "frame", (F.col("x") + F.col("left_")).alias("x"), (F.col("y") + F.col("top_")).alias("y"), "dispose", "blend",
        *(F.coalesce(F.col(c), F.lit(255.0 if c == "a" else 0.0)).cast("long").alias(c) for c in RGBA))
    stack = placed.groupBy("anim", "x", "y").agg(F.array_sort(F.collect_list(F.struct("frame", *RGBA, "dispose", "blend"))).alias("drawn"))
    clear = "named_struct('r', 0L, 'g', 0L, 'b', 0L, 'a', 0L)"
    after = f"CASE e.dispose WHEN 'background' THEN {clear} WHEN 'previous' THEN acc.now ELSE s END"
    # A let: the pixel shown is made once, as the only entry of an array.
    step = (f"element_at(transform(array({_shown('acc.now', 'e')}), s -> named_struct('now', {after}, "
            f"'done', concat(acc.done, array(named_struct('frame', e.frame, 'shown', s, 'after', {after}))))), 1)")
    kind = "struct<r:bigint,g:bigint,b:bigint,a:bigint>"
    start = f"named_struct('now', {clear}, 'done', CAST(array() AS array<struct<frame:int,shown:{kind},after:{kind}>>))"
    drawn = stack.withColumn("drawn", F.expr("transform(drawn, d -> struct(CAST(d.frame AS INT) AS frame, d.r AS r, d.g AS g, d.b AS b, d.a AS a, d.dispose AS dispose, d.blend AS blend))"))
    done = drawn.select("anim", "x", "y", F.explode(F.expr(f"aggregate(drawn, {start}, (acc, e) -> {step}, acc -> acc.done)")).alias("d")).select("anim", "x", "y", "d.*")
    canvas = placed.groupBy("anim").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    every = (frames.select("anim", F.col("frame").cast("int").alias("frame")).join(canvas, "anim")
             .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).drop("w", "h"))
    before = Window.partitionBy("anim", "x", "y").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    seen = every.join(done, ["anim", "frame", "x", "y"], "left").withColumn("left", F.last("after", ignorenulls=True).over(before))
    value = F.coalesce("shown", "left")
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.coalesce(value[c], F.lit(0)).cast("double").alias("v")) for k, c in enumerate(RGBA)))
    return seen.select("anim", "frame", "x", "y", F.explode(bands).alias("p")).select("anim", "frame", "x", "y", "p.band", "p.v")
