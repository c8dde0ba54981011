"""Retakes: phrases, similar earlier phrases, groups, and what a reviewer's replies make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from wordreel import fixed
from wordreel.functions.text import display_text, ends_clause, norm_token, strip, tenths
from wordreel.operators.detect import CUT, RANK_STEP, RETAKE_RANK
from wordreel.operators.intervals import by_words
from wordreel.operators.scan import (
    blocked, join_takes, numbered, position_block, running, with_neighbours, with_recent)
from wordreel.session import settle

SYSTEM_PROMPT = (
    "You help to edit a recording. Decide whether the numbered attempts are one line said again "
    "after a slip, or different lines that only sound alike. Emphasis and lists are not retakes. "
    "Answer with JSON only."
)
PROMPT_HEAD = "Attempts, in order:"
PROMPT_TAIL = (
    'Answer with {"retake": true or false, "keep": number of the attempt to keep, '
    '"confidence": 0 to 1, "reason": "a few words"}. Keep the most complete and fluent attempt.'
)


def phrase_bounds_measured(words: DataFrame, silences: DataFrame) -> DataFrame:
    """Add `boundary`: a measured pause begins before the next word and outlasts this one.

    Words stay in their blocks. Beside the pauses that meet a block, it is enough to know
    how far those reach that begin before the next word.
    """
    long = silences.filter(F.col("end_ms") - F.col("start_ms") >= fixed.MIN_PAUSE_MS).select(
        "take_id", F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"))
    near = with_neighbours(blocked(words), ["take_id"], "idx", next={"next_start": "start_ms"},
                           block="blk")
    lo = F.col("end_ms") - fixed.PAUSE_SLACK_MS
    near = near.withColumns({"at_": F.coalesce("next_start", "end_ms"), "kind_": F.lit(0)})
    marks = by_words(near, long, F.least(lo, "at_"), F.greatest(lo, "at_"), F.col("ps"), F.col("pe"))
    marks = marks.select("take_id", "blk", F.col("ps").alias("at_"), F.lit(1).alias("kind_"), "pe")
    w = Window.partitionBy("take_id", "blk").orderBy("at_", "kind_").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = near.unionByName(marks, allowMissingColumns=True).withColumn(
        "far_", F.max("pe").over(w)).filter("kind_ = 0")
    one = Window.partitionBy("take_id", "blk", "idx")
    return placed.withColumn("hit_", F.coalesce(F.col("far_") > lo, F.lit(False))).select(
        *words.columns, F.max("hit_").over(one).alias("boundary"))


def pauses_of_cuts(cuts: DataFrame) -> DataFrame:
    """Padded silence cuts as pauses, where only the cut list is at hand.

    They are shorter than what was measured by the padding on either side, so
    fewer of them are long enough to end a phrase.
    """
    return cuts.filter(F.col("reason") == "silence").select("take_id", "start_ms", "end_ms")


def phrase_bounds_punct(words: DataFrame) -> DataFrame:
    """Add `boundary` where nothing was measured: clause punctuation, or no text at all."""
    shown = display_text()
    return words.withColumn("boundary", ends_clause(shown) | (strip(shown) == ""))


def phrases(bounded: DataFrame, max_tokens: int = fixed.MAX_WORDS) -> DataFrame:
    """(take_id, i0, i1, start_ms, end_ms, n, text, tokens) of phrases that have a token.

    `n` counts the tokens; phrases of more than `max_tokens` have no text and no
    list of tokens here, as a take without any pause is one phrase: `phrase_words`
    has the words of every phrase as rows. Pieces of phrases are put together per
    block of words first.
    """
    return _phrases(_segments(bounded), max_tokens)


def _segments(bounded: DataFrame) -> DataFrame:
    """Words as (take_id, blk, i0, idx, start_ms, end_ms, raw, token); i0 begins their phrase.

    `edge_` marks the first and the last phrase of a block: only they can lie in others too.
    """
    base = blocked(bounded).select("take_id", "blk", "idx", "start_ms", "end_ms", "boundary",
                                   display_text().alias("raw"))
    base = base.withColumn("token", norm_token("raw"))
    lies = Window.partitionBy("take_id", "blk")
    return running(base, ["take_id"], "blk", ["idx"], maxima={
        "i0": F.when(F.col("boundary"), F.col("idx") + 1)}).withColumn(
        "i0", F.coalesce("i0", F.lit(0))).drop("boundary").withColumn(
        "edge_", (F.col("i0") == F.min("i0").over(lies)) | (F.col("i0") == F.max("i0").over(lies)))


FACTS = ("n", "last", "start_ms", "end_ms")


def _facts() -> list[Column]:
    """What there is to say about the words of a phrase in one block, in the order of FACTS."""
    return [F.count_if(F.col("token") != ""), F.max("idx"), F.min_by("start_ms", "idx"),
            F.max_by("end_ms", "idx")]


def phrase_words(bounded: DataFrame) -> DataFrame:
    """Every word of every phrase that has a token, with the phrase's i0, i1, start_ms, end_ms, n.

    (take_id, i0, i1, start_ms, end_ms, n, idx, text, token): phrases of any length,
    none of them gathered in one row. A word without a token has an empty one. Words stay
    in their blocks; a block has at most two phrases that go on in others.
    """
    segments = _segments(bounded)
    parts = segments.filter("edge_").groupBy("take_id", "blk", "i0").agg(
        *[f.alias(n) for n, f in zip(FACTS, _facts())])
    phrase = Window.partitionBy("take_id", "i0")
    crossing = parts.select(
        "take_id", "blk", "i0", F.sum("n").over(phrase).alias("n"),
        F.max("last").over(phrase).alias("last"), F.min_by("start_ms", "blk").over(phrase).alias("start_ms"),
        F.max_by("end_ms", "blk").over(phrase).alias("end_ms"),
        F.count("*").over(phrase).alias("blocks_")).filter("blocks_ > 1")
    per_block = crossing.groupBy("take_id", "blk").agg(
        F.max("take_id").alias("k_take"), F.max("blk").alias("k_blk"),
        F.collect_list(F.struct("i0", *FACTS)).alias("across_")).drop("take_id", "blk")
    here = Window.partitionBy("take_id", "blk", "i0")
    told = segments.drop("edge_").withColumns({f"h_{n}": f.over(here) for n, f in zip(FACTS, _facts())})
    joined = told.join(per_block, (F.col("take_id") == F.col("k_take"))
                       & (F.col("blk") == F.col("k_blk")), "left").withColumn(
        "x_", F.get(F.filter("across_", lambda c: c["i0"] == F.col("i0")), F.lit(0)))
    fact = {n: F.coalesce(F.col("x_")[n], F.col(f"h_{n}")) for n in FACTS}
    return joined.filter(fact["n"] > 0).select(
        "take_id", "i0", (fact["last"] + 1).alias("i1"), fact["start_ms"].alias("start_ms"),
        fact["end_ms"].alias("end_ms"), fact["n"].alias("n"), "idx", F.col("raw").alias("text"), "token")


def _phrases(segments: DataFrame, max_tokens: int) -> DataFrame:
    word = F.struct("idx", "raw", F.nullif("token", F.lit("")).alias("token"))

    def pieces(words: DataFrame) -> DataFrame:
        return words.groupBy("take_id", "blk", "i0").agg(
            *[f.alias(n) for n, f in zip(FACTS, _facts())], F.collect_list(word).alias("said")
        ).withColumn("said", F.when(F.col("n") <= max_tokens, F.col("said")))

    whole = pieces(segments.filter("edge_")).groupBy("take_id", "i0").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"),
        F.min_by("start_ms", "blk").alias("start_ms"), F.max_by("end_ms", "blk").alias("end_ms"),
        F.flatten(F.collect_list("said")).alias("said"))
    whole = pieces(segments.filter("NOT edge_")).select(*whole.columns).unionByName(whole).withColumn(
        "i1", F.col("last") + 1).withColumn("said", F.array_sort("said")).filter("n > 0")
    short = F.col("n") <= max_tokens
    return whole.select(
        "take_id", "i0", "i1", "start_ms", "end_ms", "n",
        F.when(short, strip(F.array_join(F.col("said.raw"), " "))).alias("text"),
        F.when(short, F.array_compact(F.col("said.token"))).alias("tokens"))


def numbered_phrases(found: DataFrame) -> DataFrame:
    """Add the 0-based number of each phrase in its take."""
    return numbered(found, ["take_id"], "i0", "phrase")


def usable(found: DataFrame) -> DataFrame:
    """Phrases of 6 to 40 tokens, numbered `j` after the choice."""
    fit = found.filter(F.size("tokens").between(fixed.MIN_WORDS, fixed.MAX_WORDS))
    return numbered(fit, ["take_id"], "i0", "j")


def usable_of(bounded: DataFrame) -> DataFrame:
    fit = phrases(bounded).filter(F.col("n").between(fixed.MIN_WORDS, fixed.MAX_WORDS)).drop("n")
    return usable(settle(fit, "phrases"))


def candidate_pairs(phrases_j: DataFrame) -> DataFrame:
    """Each usable phrase with the up to 8 before it, until one lies too far back.

    The earlier phrases come out of one window with copied block edges; no
    phrase is joined with any other.
    """
    grams = F.expr("array_distinct(transform(sequence(1, size(tokens) - 1),"
                   " i -> concat_ws(' ', element_at(tokens, i), element_at(tokens, i + 1))))")
    sized = phrases_j.select("take_id", "j", "i0", "start_ms", "end_ms", "tokens")
    near = with_recent(
        sized, ["take_id"], "j", "recent", F.struct("j", "i0", "end_ms", "bag", "grams", "dur"),
        fixed.LOOKBACK, derived={
            "bag": F.array_distinct("tokens"), "grams": grams,
            "dur": F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))})
    too_far = F.expr(f"array_position(transform(recent, p -> start_ms - p.end_ms >"
                     f" {fixed.RETAKE_WINDOW_MS}), true)")
    reach = F.when(too_far == 0, F.size("recent")).otherwise(too_far - 1).cast("int")
    seen = near.withColumn("recent", F.slice("recent", F.lit(1), reach))
    return seen.select("take_id", "j", "i0", "bag", "grams", "dur", F.explode("recent").alias("e"))


def similarity() -> Column:
    """0.6 of the shared words plus 0.4 of the shared word pairs, over the shorter phrase."""
    shared = F.size(F.array_intersect("bag", "e.bag"))
    pairs = F.size(F.array_intersect("grams", "e.grams"))
    longer, shorter = F.greatest("dur", "e.dur"), F.least("dur", "e.dur")
    alike = ((longer == 0) | (shorter / longer >= fixed.MIN_DURATION_RATIO)) \
        & (shared >= fixed.MIN_SHARED_WORDS) & (pairs >= fixed.MIN_SHARED_BIGRAMS)
    score = (F.lit(0.6) * (shared / F.least(F.size("bag"), F.size("e.bag")))
             + F.lit(0.4) * (pairs / F.least(F.size("grams"), F.size("e.grams"))))
    return F.when(alike, score).otherwise(F.lit(0.0))


def scored_pairs(phrases_j: DataFrame) -> DataFrame:
    return candidate_pairs(phrases_j).select(
        "take_id", "j", F.col("e.j").alias("earlier"), similarity().alias("score"))


def best_links(phrases_j: DataFrame) -> DataFrame:
    """The most similar earlier phrase of each, the furthest back of equals."""
    likely = scored_pairs(phrases_j).filter(F.col("score") >= fixed.MIN_SIMILARITY)
    best = F.max_by(F.struct("earlier", "score"), F.struct(F.col("score"), -F.col("earlier")))
    return likely.groupBy("take_id", "j").agg(best.alias("best")).select("take_id", "j", "best.*")


def groups(links: DataFrame) -> DataFrame:
    """(take_id, grp, j): attempts at one line, numbered by the order groups open.

    Links point back, so they form a forest. Every round a phrase takes over
    the target of its target; chains halve, and a round that moves nothing ends it.
    """
    ends = settle(links.select("take_id", "j", F.col("earlier").alias("root")), "links")
    while True:
        moved = Observation()
        jump = ends.select("take_id", F.col("j").alias("root"), F.col("root").alias("further"))
        ends = settle(join_takes(ends, jump, how="left", on=["take_id", "root"]).observe(
            moved, F.count("further").alias("n")).select(
            "take_id", "j", F.coalesce("further", "root").alias("root")), "links")
        if not moved.get["n"]:
            break
    opened = ends.groupBy("take_id", "root").agg(F.min("j").alias("opened"))
    order = numbered(opened, ["take_id"], "opened", "grp")
    members = ends.select("take_id", "root", "j").unionByName(
        opened.select("take_id", "root", F.col("root").alias("j")))
    return join_takes(members, order.select("take_id", "root", "grp"),
                      on=["take_id", "root"]).select("take_id", "grp", "j")


def group_counts(members: DataFrame, n: int = fixed.MAX_GROUPS) -> DataFrame:
    """How many groups a take has, and how many are asked about under the cap."""
    per = members.groupBy("take_id").agg((F.max("grp") + 1).alias("found"))
    return per.select("take_id", "found", F.least(F.lit(n), "found").alias("asked"),
                      F.greatest(F.lit(0), F.col("found") - n).alias("skipped"))


def cap_groups(members: DataFrame, n: int = fixed.MAX_GROUPS) -> DataFrame:
    """Attempts of the first `n` groups of each take; the cap is the caller's cost limit."""
    return members.filter(F.col("grp") < n)


def attempts(members: DataFrame, phrases_j: DataFrame) -> DataFrame:
    """(take_id, grp, at, j, start_ms, end_ms, text): members in order with their phrase."""
    said = members.join(
        phrases_j.select("take_id", "j", "i0", "start_ms", "end_ms", "text"), ["take_id", "j"])
    # Position within the group, counted per block of phrases so that one
    # endless group is still many small windows.
    said = said.withColumn("blk_", position_block("j"))
    return running(said, ["take_id", "grp"], "blk_", ["j"], sums={"at": F.lit(1)}).drop("blk_")


def retake_prompts(members: DataFrame) -> DataFrame:
    """(take_id, grp, line_no, line): the question about each group, line by line.

    The lines of a group in their order, joined by line ends, are one question,
    however many attempts it has.
    """
    said = F.concat(F.lit("["), F.col("at").cast("string"), F.lit("] "), tenths(F.col("start_ms")),
                    F.lit("s-"), tenths(F.col("end_ms")), F.lit("s: "), F.col("text"))
    attempts_ = members.select("take_id", "grp", (F.col("at") + 1).alias("line_no"),
                               said.alias("line"))
    frame = members.groupBy("take_id", "grp").agg(F.count("*").alias("size")).select(
        "take_id", "grp", F.explode(F.array(
            F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit(PROMPT_HEAD).alias("line")),
            F.struct((F.col("size") + 1).alias("line_no"), F.lit("").alias("line")),
            F.struct((F.col("size") + 2).alias("line_no"), F.lit(PROMPT_TAIL).alias("line"))))
        .alias("x")).select("take_id", "grp", "x.*")
    return frame.unionByName(attempts_)


def prompt_digests(lines: DataFrame) -> DataFrame:
    """(take_id, grp, digest) of prompts (take_id, grp, line_no, line), which never meet in one row."""
    one = lambda *more: F.lpad(F.hex(F.bit_xor(F.xxhash64(
        "line_no", "line", *more))), 16, "0")
    return lines.groupBy("take_id", "grp").agg(
        F.concat(one(), one(F.lit("second")), F.hex(F.count("*"))).alias("digest"))


def next_prompts(digests: DataFrame, replies: DataFrame, width: int = fixed.MAX_GROUPS,
                 tries: int = 1) -> DataFrame:
    """(take_id, grp, digest, attempt): what the next wave asks, over restarts too.

    `replies` (digest, ok) is the log of all asking so far. A question that has a good
    reply is not asked again, and one that several takes share is asked for the first
    of them. A take asks its first `width` open questions; once one of them has failed
    it is asked alone, and after `tries` failures the take asks no more, as the rest
    would fail alike.
    """
    log = replies.groupBy("digest").agg(F.bool_or("ok").alias("answered"),
                                        F.count_if(~F.col("ok")).alias("failures"))
    state = join_takes(digests, log, "left", "digest").withColumns({
        "answered": F.coalesce("answered", F.lit(False)),
        "failures": F.coalesce("failures", F.lit(0))})
    waiting = state.filter(~F.col("answered"))
    first = waiting.groupBy("take_id").agg(
        F.min("grp").alias("first"), F.min(F.when(F.col("failures") > 0, F.col("grp"))).alias("failed"),
        F.max("failures").alias("most"))
    open_ = join_takes(waiting, first.filter(F.col("most") < tries))
    wave = open_.filter(F.when(F.col("failed").isNotNull(), F.col("grp") == F.col("failed"))
                        .otherwise(F.col("grp") < F.col("first") + width))
    asked = wave.groupBy("digest").agg(
        F.min(F.struct("take_id", "grp")).alias("p"), F.max("failures").alias("failures"))
    return asked.select("p.take_id", "p.grp", "digest", (F.col("failures") + 1).alias("attempt"))


def verdicts(replies: DataFrame, sizes: DataFrame) -> DataFrame:
    """Replies that really say so, by exact JSON type.

    `replies` has a variant column `answer`; "true", 1 and 1.0 are not true,
    and the attempt to keep must be a whole number inside the group.
    """
    kind = lambda path: F.expr(f"schema_of_variant(variant_get(answer, '$.{path}'))")
    whole = F.expr("try_variant_get(answer, '$.keep', 'bigint')")
    sure = F.expr("try_cast(try_variant_get(answer, '$.confidence', 'string') AS double)")
    held = F.when(sure.isNull() | F.isnan(sure), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)))
    said = replies.join(sizes, ["take_id", "grp"]).filter(
        (kind("retake") == "BOOLEAN")
        & F.expr("try_variant_get(answer, '$.retake', 'boolean')")
        & (kind("keep") == "BIGINT") & (whole >= 0) & (whole < F.col("size")))
    return said.select(
        "take_id", "grp", whole.alias("keep"),
        F.floor(held * 100 + 0.5).cast("int").alias("confidence_pct"),
        F.substring(F.coalesce(F.expr("try_variant_get(answer, '$.reason', 'string')"), F.lit("")),
                    1, 200).alias("reason"))


def retake_cuts(members: DataFrame, judged: DataFrame) -> DataFrame:
    """Every attempt but the one kept, always as a suggestion."""
    both = join_takes(members, judged.drop("reason"), on=["take_id", "grp"])
    return both.filter(F.col("at") != F.col("keep")).select(
        "take_id", "start_ms", "end_ms", F.lit("retake").alias("reason"), "confidence_pct",
        F.substring("text", 1, 120).alias("text"), F.lit(False).alias("auto"),
        (F.col("i0") + F.lit(RETAKE_RANK * RANK_STEP)).alias("ord")).select(*CUT)


def retake_report(members: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per attempt of a confirmed group, and whether it is dropped."""
    both = join_takes(members, judged, on=["take_id", "grp"])
    return both.select("take_id", "grp", "at", "keep", "confidence_pct", "reason", "start_ms",
                       "end_ms", "text", (F.col("at") != F.col("keep")).alias("dropped"))


def retake_status(takes: DataFrame, counts: DataFrame, replies: DataFrame, judged: DataFrame,
                  model: bool = True) -> DataFrame:
    """How the run ended for each take, and how many groups were asked and skipped.

    Asking stops at the first failed reply; `replies` has `ok` and `error` per
    group, and the error of that reply is the run's.
    """
    if not model:
        return takes.select("take_id", F.lit("no-model").alias("status"),
                            F.lit(None).cast("string").alias("error"),
                            F.lit(0).cast("bigint").alias("asked"),
                            F.lit(0).cast("bigint").alias("skipped"))
    asked = replies.join(counts.select("take_id", F.col("asked").alias("cap")), "take_id").filter(
        F.col("grp") < F.col("cap"))
    failed = F.when(~F.col("ok"), F.col("grp"))
    broke = asked.groupBy("take_id").agg(F.min(failed).alias("broke"),
                                         F.min_by("error", failed).alias("error"))
    state = (takes.select("take_id").join(counts, "take_id", "left").join(broke, "take_id", "left"))
    confirmed = judged.select("take_id", "grp").join(
        state.select("take_id", "broke", F.col("asked").alias("cap")), "take_id").filter(
        (F.col("grp") < F.col("cap")) & (F.col("broke").isNull() | (F.col("grp") < F.col("broke"))))
    state = state.join(confirmed.groupBy("take_id").agg(F.count("*").alias("confirmed")),
                       "take_id", "left")
    return state.select(
        "take_id",
        F.when(F.coalesce("found", F.lit(0)) == 0, "none-found")
        .when(F.col("broke").isNotNull(), "model-error")
        .when(F.coalesce("confirmed", F.lit(0)) == 0, "none-confirmed").otherwise("ok").alias("status"),
        F.when(F.col("broke").isNotNull(), F.col("error")).alias("error"),
        F.coalesce(F.col("broke") + 1, "asked", F.lit(0)).alias("asked"),
        F.coalesce(F.when(F.col("broke").isNotNull(), F.col("found") - F.col("broke") - 1)
                   .otherwise(F.col("skipped")), F.lit(0)).alias("skipped"))


def before_failure(judged: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdicts given before the first failed reply of the take."""
    broke = replies.filter(~F.col("ok")).groupBy("take_id").agg(F.min("grp").alias("broke"))
    return judged.join(broke, "take_id", "left").filter(
        F.col("broke").isNull() | (F.col("grp") < F.col("broke"))).drop("broke")


def reply_errors(replies: DataFrame) -> DataFrame:
    """What went wrong with a call, from its HTTP status, in words a user can act on."""
    status, name = F.col("http_status"), F.col("provider")
    code = status.cast("string")
    detail = F.substring(F.replace(strip("body"), F.lit("\n"), F.lit(" ")), 1, 160)
    return replies.filter(status != 200).withColumn("error", (
        F.when(status.isin(401, 403),
               F.concat(name, F.lit(" rejected the API key (HTTP "), code, F.lit(")")))
        .when(status == 429, F.concat(name, F.lit(" rate limit or quota reached (HTTP 429)")))
        .when(status >= 500, F.concat(name, F.lit(" is having trouble (HTTP "), code, F.lit(")")))
        .otherwise(F.concat(name, F.lit(" returned HTTP "), code, F.lit(": "), detail))))


def promote(cuts: DataFrame, found: DataFrame) -> DataFrame:
    """Apply retake suggestions on request: added as they are, without new padding."""
    return cuts.unionByName(found.withColumn("auto", F.lit(True)))
