"""Frame sampling, segments and scene changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.detections import let


def segment(start: Column, end: Column) -> Column:
    """A checked segment: it begins at 0 or later, and ends where it begins or later unless its end is negative."""
    made = F.struct(start.cast("int").alias("start_fno"), end.cast("int").alias("end_fno"))
    right = (start >= 0) & ((end < 0) | (end >= start))
    return F.when(start.isNotNull() & end.isNotNull(), F.when(right, made).otherwise(F.raise_error(F.lit("not a segment")).cast("struct<start_fno:int,end_fno:int>")))


def sampled_frames(segment_: Column, n_frames: Column, rate: Column | int, most: Column | int) -> Column:
    """Frame numbers that the sampler emits: one of every ``rate`` from the start.

    The number of frames is bounded by ``most`` (negative: no bound) and, where
    the segment has an end, by its length.  The bound is on emitted frames, so
    with a rate over 1 frames behind the segment's end may be sampled.
    """
    rate, most = (F.lit(v) if isinstance(v, int) else v for v in (rate, most))
    start, end = segment_["start_fno"], segment_["end_fno"]
    there = F.when(start < n_frames, F.ceil((n_frames - start) / rate)).otherwise(F.lit(0)).cast("int")
    length = end - start
    bound = F.when(end > 0, F.when(most >= 0, F.least(length, most)).otherwise(length)).otherwise(most)
    n = F.when(bound >= 0, F.least(bound, there)).otherwise(there)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: start + i * rate)).otherwise(F.array().cast("array<int>"))


def scenes(frames: DataFrame, video: str, frame: str, value: str, position: str, threshold: float = 30.0) -> DataFrame:
    """Scenes of each video: a new one begins where ``value`` changes by over ``threshold``.

    ``frames`` has a row for each frame with a content value.  The result has
    each scene's first frame and the one behind its last, with positions.
    """
    w = Window.partitionBy(video).orderBy(frame)
    cut = (F.abs(F.col(value) - F.lag(value).over(w)) > threshold).cast("int")
    number = F.sum(F.coalesce("_cut", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    marked = frames.withColumn("_cut", cut).withColumn("scene", number)
    found = marked.groupBy(video, "scene").agg(F.min(frame).alias("start_frame"), F.min(position).alias("start_pos"), F.max(frame).alias("last_frame"), F.max(position).alias("last_pos"))
    after = Window.partitionBy(video).orderBy("scene")
    return found.select(video, "scene", "start_frame", "start_pos", F.coalesce(F.lead("start_frame").over(after), F.col("last_frame")).alias("end_frame"), F.coalesce(F.lead("start_pos").over(after), F.col("last_pos")).alias("end_pos"))


#: What the metadata of a video has.
METADATA = "struct<width:int,height:int,num_frames:int,duration:float,bit_rate:int,frame_rate:int,codec:string,size:int,_errors:struct<message:string,stderr:string,probe:string>>"
_PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,nb_frames:string,duration:string,bit_rate:string,avg_frame_rate:string>>,format:struct<size:string>>"


def metadata_of_probe(probe: Column) -> Column:
    """Video metadata from a prober's JSON; what is missing is null, what is wrong goes to ``_errors``."""
    first = lambda parsed: F.get(F.filter(parsed["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    # Each step is computed once: Spark would parse the text again for every field.
    return let(probe, lambda text: let(F.from_json(text, _PROBE), lambda parsed: let(first(parsed), lambda stream: _metadata(text, parsed, stream))))


def _metadata(probe: Column, parsed: Column, stream: Column) -> Column:
    ratio = F.split(stream["avg_frame_rate"], "/")
    top, bottom = (F.get(ratio, F.lit(i)).try_cast("double") for i in (0, 1))
    message = F.when(stream.isNull(), F.lit("no video stream")).when(bottom == 0, F.lit("frame rate has a zero denominator"))
    values = {
        "width": stream["width"], "height": stream["height"], "num_frames": stream["nb_frames"].try_cast("int"), "duration": stream["duration"].try_cast("float"), "bit_rate": stream["bit_rate"].try_cast("int"),
        "frame_rate": F.round(top / F.when(bottom != 0, bottom)).cast("int"), "codec": stream["codec_name"], "size": parsed["format"]["size"].try_cast("int"),
    }
    good = message.isNull()
    errors = F.when(~good, F.struct(message.alias("message"), F.lit(None).cast("string").alias("stderr"), probe.alias("probe")))
    return F.when(probe.isNotNull(), F.struct(*[F.when(good, v).alias(n) for n, v in values.items()], errors.alias("_errors")))
