"""The tightening run: words to cuts, cuts to kept spans, words onto the new timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordreel.operators import detect as D, intervals as I
from wordreel.session import settle
from wordreel.sources import tables as T

# Words that do occur in the given documents, in the three classes.
LEXICON = D.Lexicon(
    nonlexical=("er",),
    lexical=("the", "and", "of", "de", "la", "der", "que"),
    reduplicated=("to", "le"),
)


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(words, media): words as a plan, which is cheaper to run again than to write out;
    media, one row per take, written."""
    return T.words(spark, sf_dir), settle(T.media(spark, sf_dir), "media")


def raw_cuts(words: DataFrame) -> DataFrame:
    return settle(D.detect(words, lexicon=LEXICON), "raw-cuts")


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, media = inputs(spark, sf_dir)
    return D.merge_cuts(raw_cuts(words), media)


def tightened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, media, merged cuts); media and cuts are written."""
    words, media = inputs(spark, sf_dir)
    return words, media, settle(D.merge_cuts(raw_cuts(words), media), "cuts")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much dead air, filler and stutter is in each take, and what is left without it."""
    words, media = inputs(spark, sf_dir)
    return D.summarize(D.merge_cuts(raw_cuts(words), media), media)


def kept(media: DataFrame, merged: DataFrame) -> DataFrame:
    return I.keep_segments(merged.filter("auto"), media)


def spans(media: DataFrame, merged: DataFrame) -> DataFrame:
    return I.with_offsets(settle(kept(media, merged), "kept"))


def retimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, media, merged = tightened(spark, sf_dir)
    return I.retime(I.assign_words(words, spans(media, merged)))
