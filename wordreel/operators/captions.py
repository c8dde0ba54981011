"""Captions: styles, cues, word-by-word events, and subtitle documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wordreel import fixed
from wordreel.functions.text import first_text, strip
from wordreel.functions.timefmt import ass_time, srt_time
from wordreel.operators.scan import blocked, carried, join_takes, running

FULL = "&H00"


# Styles ----------------------------------------------------------------------

def presets(spark: SparkSession) -> DataFrame:
    """The four presets: a fixed, tiny dimension."""
    return spark.createDataFrame(fixed.STYLE_PRESETS, fixed.STYLE_FIELDS)


def resolve_styles(requests: DataFrame, preset_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(styles, rejects) for requests (request_id, style_json).

    Fields given in the JSON replace those of the preset; a given `animation`
    replaces the preset's as a whole, its own gaps filled from the defaults.
    """
    said = requests.withColumn("given", F.from_json(
        "style_json", fixed.STYLE_FIELDS + ", _corrupt_record string"))
    said = said.withColumn("given", F.when(F.col("given._corrupt_record").isNull(), F.col("given")))
    said = said.withColumn("wanted", F.coalesce("given.preset", F.lit("default")))
    base = preset_rows.select(F.col("preset").alias("wanted"), F.struct("*").alias("base"))
    joined = said.join(base, "wanted", "left")
    kind, low, high, ms = fixed.ANIMATION_DEFAULTS
    own = F.struct(F.coalesce("given.animation.type", F.lit(kind)).alias("type"),
                   F.coalesce("given.animation.scale_start", F.lit(low)).alias("scale_start"),
                   F.coalesce("given.animation.scale_end", F.lit(high)).alias("scale_end"),
                   F.coalesce("given.animation.duration_ms", F.lit(ms)).alias("duration_ms"))
    names = [f for f in preset_rows.columns if f not in ("preset", "animation")]
    styles = joined.filter("base IS NOT NULL AND given IS NOT NULL").select(
        "request_id", F.col("wanted").alias("preset"),
        *[F.coalesce(f"given.{n}", f"base.{n}").alias(n) for n in names],
        F.when(F.col("given.animation").isNotNull(), own).otherwise(F.col("base.animation"))
        .alias("animation"))
    rejects = joined.filter("base IS NULL OR given IS NULL").select(
        "request_id", F.when(F.col("given").isNull(), "style is not a JSON object").otherwise(
            F.concat(F.lit("unknown preset "), F.col("wanted"))).alias("error"))
    return styles, rejects


def validate_styles(styles: DataFrame) -> DataFrame:
    """Add `problems`: the fields that are out of range or not colours."""
    checks = [F.when(~F.col(f).between(lo, hi), F.lit(f)) for f, lo, hi in fixed.STYLE_RANGES]
    checks += [F.when(~F.col(c).rlike(fixed.COLOR_PATTERN), F.lit(c)) for c in fixed.STYLE_COLORS]
    checks.append(F.when(~F.col("animation.type").isin(*fixed.ANIMATION_TYPES), "animation.type"))
    return styles.withColumn("problems", F.array_compact(F.array(*checks)))


def subtitle_color(hex_color: Column) -> Column:
    """#RRGGBB or #RRGGBBAA as &HAABBGGRR, where AA counts transparency."""
    rgb = F.upper(F.regexp_extract(hex_color, fixed.COLOR_PATTERN, 1))
    alpha = F.regexp_extract(hex_color, fixed.COLOR_PATTERN, 2)
    clear = F.when(alpha == "", "00").otherwise(
        F.lpad(F.hex(F.lit(255) - F.conv(alpha, 16, 10).cast("bigint")), 2, "0"))
    return F.concat(F.lit("&H"), clear, F.substring(rgb, 5, 2), F.substring(rgb, 3, 2),
                    F.substring(rgb, 1, 2))


# Cues ------------------------------------------------------------------------

def display_words(words: DataFrame, text_key: str = "text") -> DataFrame:
    """(take_id, rn, start_ms, end_ms, shown): words with something to show, renumbered."""
    shown = first_text(text_key, "text") if text_key != "text" else first_text("text")
    kept = blocked(words).withColumn("shown", shown).filter(strip("shown") != "")
    kept = kept.select("take_id", "blk", "idx", "start_ms", "end_ms", "shown")
    placed = running(kept, ["take_id"], "blk", ["idx"], sums={"rn": F.lit(1)}).drop("idx")
    return placed if carried(words) else placed.drop("blk")


def cues(display: DataFrame, n: int | Column = 3) -> DataFrame:
    """(take_id, cue, start_ms, end_ms, text): `n` words at a time."""
    return chunks(display, n).select(
        "take_id", "cue", F.col("said")[0]["start_ms"].alias("start_ms"),
        F.element_at("said", -1)["end_ms"].alias("end_ms"),
        F.array_join(F.col("said.shown"), " ").alias("text"))


def chunks(display: DataFrame, n: int | Column, *carry: str) -> DataFrame:
    """One row per cue with its words as an array; at most a handful each.

    Words that lie by blocks are put together there; of a block's cues only the first
    and the last can lack words, and are joined with their other part.
    """
    n = F.lit(n) if isinstance(n, int) else n
    numbered = display.withColumn("cue", F.floor(F.col("rn") / n).cast("bigint"))
    word = F.struct("rn", "start_ms", "end_ms", "shown")
    said = F.array_sort(F.collect_list(word)).alias("said")
    if not carried(display):
        return numbered.groupBy("take_id", "cue", *carry).agg(said)
    lies = Window.partitionBy("take_id", "blk")
    ends = numbered.withColumns({"lo_": F.min("rn").over(lies), "hi_": F.max("rn").over(lies)})
    whole = F.coalesce((F.col("cue") * n >= F.col("lo_")) & ((F.col("cue") + 1) * n <= F.col("hi_") + 1),
                       F.lit(False))
    cue = Window.partitionBy("take_id", "blk", "cue", *carry).orderBy("rn")
    here = ends.filter(whole).select("take_id", "blk", "cue", "rn", *carry, F.collect_list(word).over(
        cue.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("said"))
    here = here.filter(F.col("said")[0]["rn"] == F.col("rn"))
    parts = ends.filter(~whole).groupBy("take_id", "cue", *carry).agg(said)
    return here.select(*parts.columns).unionByName(parts)


def text_lines(rows: DataFrame, line_no: Column, lines: Column) -> DataFrame:
    """(take_id, line_no, sub, line): documents as lines, whatever their length.

    `lines` is the array of lines that a row adds; `line_no` orders the rows of a
    take. In the order of (line_no, sub), each with its line end, the lines are
    the document.
    """
    return rows.select("take_id", line_no.cast("bigint").alias("line_no"),
                       F.posexplode(lines).alias("sub", "line")).withColumn(
        "sub", F.col("sub").cast("bigint"))


def split_lines(text: Column) -> Column:
    """Lines of a text that ends with a line end or without one."""
    return F.split(F.regexp_replace(text, "\n$", ""), "\n")


def srt_lines(cue_rows: DataFrame) -> DataFrame:
    """Subtitle documents: number, time, text, and an empty line between two cues."""
    gap = F.when(F.col("cue") > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    head = F.array((F.col("cue") + 1).cast("string"), F.concat(
        srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms"))))
    return text_lines(cue_rows, F.col("cue"), F.concat(gap, head, F.split("text", "\n")))


# Word-by-word events ---------------------------------------------------------

@dataclass(frozen=True)
class Markup:
    """The few columns that differ between whole-video and clip captions."""

    text_color: Column
    highlight: Column
    dim: Column
    upper: Column
    animation: Column
    scale_start: Column
    scale_end: Column
    overshoot_ms: Column
    settle_ms: Column
    fade_ms: Column
    active_scale: Column


def style_markup() -> Markup:
    """Markup from a `style` struct as `resolve_styles` makes it."""
    ms = F.col("style.animation.duration_ms")
    overshoot = F.greatest(F.lit(1), F.floor(ms * 6 / 10).cast("bigint"))
    return Markup(
        text_color=subtitle_color(F.col("style.text_color")),
        highlight=subtitle_color(F.col("style.highlight_color")),
        dim=F.concat(F.lit("&H"), F.lpad(F.hex(F.col("style.dim_alpha").cast("bigint")), 2, "0")),
        upper=F.col("style.uppercase"),
        animation=F.col("style.animation.type"),
        scale_start=F.col("style.animation.scale_start"),
        scale_end=F.col("style.animation.scale_end"),
        overshoot_ms=overshoot, settle_ms=F.greatest(F.lit(1), ms - overshoot), fade_ms=ms,
        active_scale=F.floor(F.col("style.highlight_scale") * 100).cast("bigint"))


def clip_markup() -> Markup:
    """Markup of clip captions: always upper case, fixed settling time and scale."""
    return Markup(
        text_color=F.col("style.text_color"), highlight=F.col("style.highlight"),
        dim=F.lit("&HAA"), upper=F.lit(True), animation=F.col("style.anim"),
        scale_start=F.col("style.scale_start"), scale_end=F.col("style.scale_end"),
        overshoot_ms=F.col("style.duration_ms"), settle_ms=F.lit(100),
        fade_ms=F.col("style.duration_ms"), active_scale=F.lit(115))


def _text(c) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.lit(str(c))


def _tag(color: Column, alpha: Column | str, scale: Column | int = 100) -> Column:
    return F.concat(F.lit("{\\c"), color, F.lit("\\alpha"), _text(alpha), F.lit("\\fscx"),
                    _text(scale), F.lit("\\fscy"), _text(scale), F.lit("}"))


def _pop(m: Markup) -> Column:
    end = m.overshoot_ms + m.settle_ms
    return F.concat(
        F.lit("{\\c"), m.highlight, F.lit("\\alpha" + FULL + "\\fscx"), _text(m.scale_start),
        F.lit("\\fscy"), _text(m.scale_start), F.lit("\\t(0,"), _text(m.overshoot_ms),
        F.lit(",\\fscx"), _text(m.scale_end), F.lit("\\fscy"), _text(m.scale_end), F.lit(")\\t("),
        _text(m.overshoot_ms), F.lit(","), _text(end), F.lit(",\\fscx100\\fscy100)}"))


def _fade(m: Markup) -> Column:
    return F.concat(F.lit("{\\c"), m.highlight, F.lit("\\alpha&HFF\\t(0,"), _text(m.fade_ms),
                    F.lit(",\\alpha" + FULL + ")}"))


def _shown(m: Markup, word: Column) -> Column:
    plain = F.translate(word["shown"], "{}", "")
    return F.when(m.upper, F.upper(plain)).otherwise(plain)


def word_events(display: DataFrame, styles: DataFrame, m: Markup) -> DataFrame:
    """(take_id, n, start_ms, end_ms, body): a line per spoken word, or per cue for karaoke.

    `display` carries a `style_id`, `styles` is (style_id, style). A word lasts
    until the next of its cue, the last one until the cue ends, and never no
    time at all. Only the number of words per line goes through the grouping;
    the rest of the style joins the finished cues.
    """
    per_line = styles.select("style_id", F.col("style.words_per_line").alias("per_line"))
    sized = join_takes(display, per_line, on="style_id")
    rows = join_takes(chunks(sized, F.col("per_line"), "style_id"), styles, on="style_id")
    karaoke = m.animation == "karaoke"
    single = rows.select("take_id", "style", "said", F.posexplode("said").alias("at", "word")).filter(
        ~karaoke | (F.col("at") == 0))

    back = _tag(m.text_color, FULL)
    entrance = F.when(m.animation == "pop", _pop(m)).when(m.animation == "fade", _fade(m)) \
        .otherwise(_tag(m.highlight, FULL, m.active_scale))
    single = single.withColumns({"past_": back, "now_": entrance,
                                 "later_": _tag(m.text_color, m.dim)})
    marked = F.transform("said", lambda w, i: F.concat(
        F.when(i < F.col("at"), F.col("past_")).when(i == F.col("at"), F.col("now_"))
        .otherwise(F.col("later_")), _shown(m, w),
        F.when(i == F.col("at"), F.col("past_")).otherwise("")))
    sung = F.transform("said", lambda w: F.concat(
        F.lit("{\\kf"),
        F.greatest(F.floor((w["end_ms"] - w["start_ms"]) / 10).cast("bigint"), F.lit(10))
        .cast("string"), F.lit("}"), _shown(m, w)))
    start, cue_end = F.col("word.start_ms"), F.element_at("said", -1)["end_ms"]
    until = F.coalesce(F.expr("try_element_at(said, at + 2).start_ms"), cue_end)
    return single.select(
        "take_id", F.col("word.rn").alias("n"), start.alias("start_ms"),
        F.when(karaoke, cue_end).when(until <= start, start + 100).otherwise(until).alias("end_ms"),
        F.when(karaoke, F.array_join(sung, " ")).otherwise(
            F.concat(F.array_join(marked, " "), F.col("past_"))).alias("body"))


def event_line() -> Column:
    return F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","),
                    ass_time(F.col("end_ms")), F.lit(",Caption,,0,0,0,,"), F.col("body"))


# The subtitle format's section and field names.
SCRIPT_HEAD = "[Script Info]\nScriptType: v4.00+\nPlayResX: {w}\nPlayResY: {h}\nWrapStyle: 1\n\n"
STYLE_HEAD = (
    "[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, "
    "Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, "
    "Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n")
EVENT_HEAD = (
    "\n[Events]\n"
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n")


def ass_header(width: Column, height: Column, text: Column, highlight: Column, outline: Column,
               shadow: Column, alignment: Column, big: Column) -> Column:
    """Header text of a subtitle document for a `style` struct."""
    def line(name: str, size: Column, color: Column) -> Column:
        return F.concat(
            F.lit(f"Style: {name},"), F.col("style.font"), F.lit(","), _text(size), F.lit(","), color,
            F.lit(",&H000000FF,"), outline, F.lit(","), shadow,
            F.lit(",-1,0,0,0,100,100,2,0,1,"), _text(F.col("style.outline_width")), F.lit(","),
            _text(F.col("style.shadow_width")), F.lit(","), _text(alignment), F.lit(",40,40,"),
            _text(F.col("style.margin_v")), F.lit(",1\n"))

    before, after = SCRIPT_HEAD.split("{w}")
    between, after = after.split("{h}")
    return F.concat(F.lit(before), _text(width), F.lit(between), _text(height), F.lit(after),
                    F.lit(STYLE_HEAD), line("Caption", F.col("style.font_size"), text),
                    line("Highlight", big, highlight), F.lit(EVENT_HEAD))


def style_header(width: Column, height: Column) -> Column:
    color = lambda f: subtitle_color(F.col(f"style.{f}"))
    big = F.floor(F.col("style.font_size") * F.col("style.highlight_scale")).cast("bigint")
    return ass_header(width, height, color("text_color"), color("highlight_color"),
                      color("outline_color"), color("shadow_color"), F.col("style.alignment"), big)


def clip_header() -> Column:
    big = F.floor(F.col("style.font_size") * 1.12).cast("bigint")
    return ass_header(F.lit(1080), F.lit(1920), F.col("style.text_color"), F.col("style.highlight"),
                      F.col("style.outline_color"), F.col("style.shadow_color"), F.lit(2), big)


def ass_lines(events: DataFrame, heads: DataFrame) -> DataFrame:
    """Styled subtitle documents; `heads` has (take_id, head), also for takes without events."""
    first = text_lines(heads, F.lit(0), split_lines(F.col("head")))
    return first.unionByName(text_lines(events, F.col("n") + 1, F.array(event_line())))


def clip_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.CLIP_PRESETS,
        "preset string, font string, font_size int, text_color string, highlight string, "
        "outline_color string, shadow_color string, outline_width int, shadow_width int, "
        "words_per_line int, margin_v int, anim string, scale_start int, scale_end int, "
        "duration_ms int")
