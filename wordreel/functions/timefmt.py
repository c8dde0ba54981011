"""Time as text, built from whole numbers so that every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wordreel.functions.text import pad


def _div(x: Column, n) -> Column:
    return F.floor(x / n).cast("bigint")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    return F.concat(pad(_div(ms, 3_600_000), 2), F.lit(":"), pad(_div(ms, 60_000) % 60, 2),
                    F.lit(":"), pad(_div(ms, 1000) % 60, 2), F.lit(","), pad(ms % 1000, 3))


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc; hundredths are half up, and 59.995 shows as 60.00."""
    rest = ms % 60_000
    cs = _div(rest + 5, 10)
    return F.concat(_div(ms, 3_600_000).cast("string"), F.lit(":"), pad(_div(ms, 60_000) % 60, 2),
                    F.lit(":"), pad(_div(cs, 100), 2), F.lit("."), pad(cs % 100, 2))


def timebase(fps: Column) -> Column:
    """Frames counted per second: the nearest whole rate, ties to even."""
    return F.rint(fps).cast("bigint")


def is_ntsc(fps: Column) -> Column:
    return F.abs(fps - timebase(fps) * F.lit(1000.0) / F.lit(1001.0)) < 0.01


def is_drop(fps: Column) -> Column:
    return is_ntsc(fps) & timebase(fps).isin(30, 60)


def exact_rate(fps: Column) -> Column:
    base = timebase(fps)
    return F.when(is_ntsc(fps), base * F.lit(1000.0) / F.lit(1001.0)).otherwise(base.cast("double"))


def frame_at(ms: Column, fps: Column) -> Column:
    """The frame nearest to a time, ties to even."""
    return F.rint(ms / F.lit(1000.0) * exact_rate(fps)).cast("bigint")


def timecode(frame: Column, fps: Column) -> Column:
    """HH:MM:SS:FF, or HH:MM:SS;FF where labels are dropped to keep up with the clock.

    Two labels (four at 60) are skipped at each minute but every tenth, so a
    frame's label runs ahead by the labels skipped until then.
    """
    base = timebase(fps)
    skip = F.when(base == 30, 2).otherwise(4)
    ten_minutes = base * 600 - skip * 9
    in_ten = frame % ten_minutes
    minutes = F.greatest(F.lit(0), _div(in_ten - skip, base * 60 - skip))
    label = F.when(is_drop(fps), frame + skip * (_div(frame, ten_minutes) * 9 + minutes)) \
        .otherwise(frame)
    seconds = _div(label, base)
    return F.concat(pad(_div(seconds, 3600), 2), F.lit(":"), pad(_div(seconds, 60) % 60, 2),
                    F.lit(":"), pad(seconds % 60, 2), F.when(is_drop(fps), ";").otherwise(":"),
                    pad(label % base, 2))


def rational(frames: Column, fps: Column) -> Column:
    """Frames as an exact fraction of a second."""
    base = timebase(fps)
    text = frames.cast("bigint").cast("string")
    ntsc = F.concat((frames * 1001).cast("bigint").cast("string"), F.lit("/"),
                    (base * 1000).cast("string"), F.lit("s"))
    plain = F.concat(text, F.lit("/"), base.cast("string"), F.lit("s"))
    return F.when(frames == 0, "0s").when(is_ntsc(fps), ntsc).otherwise(plain)


def frame_duration(fps: Column) -> Column:
    return rational(F.lit(1), fps)


def length_ms(text: Column) -> Column:
    """ "60", "1:00" or "1:02.5" in ms; NULL unless finite and positive."""
    parts = F.reverse(F.split(F.btrim(text), ":"))
    seconds = F.aggregate(
        F.transform(parts, lambda p, i: p.try_cast("double") * F.pow(F.lit(60.0), i)),
        F.lit(0.0), lambda a, x: a + x)
    fine = ~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf"))
    return F.when(fine, F.round(seconds * 1000).cast("bigint"))
