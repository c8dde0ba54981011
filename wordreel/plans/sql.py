"""The same questions in plain SQL, written without regard to scale, as a check."""

from __future__ import annotations

import re

# Named sub-queries over the given tables; `sql` pulls in those a statement uses.
PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body.strip()


def sql(final: str, **local: str) -> str:
    """`final` preceded by every named part it refers to, directly or not."""
    known = {**PARTS, **local}
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in re.findall(r"[a-z_][a-z_0-9]*", text):
            if name in known and name not in order and name not in seen:
                visit(known[name], (*seen, name))
                if name not in order:
                    order.append(name)

    visit(final, ())
    if not order:
        return final.strip()
    recursive = "RECURSIVE " if any("--recursive" in known[n] for n in order) else ""
    once = lambda n: " MATERIALIZED" if "--materialized" in known[n] else ""
    return (f"WITH {recursive}" + ",\n".join(f"{n} AS{once(n)} (\n{known[n]}\n)" for n in order)
            + "\n" + final.strip())


part("spoken_lists", r"""
SELECT doc_id AS take_id,
       list_filter(regexp_split_to_array(text, '[ \n\r\t]+'), lambda x: x <> '') AS toks
FROM documents""")
part("spoken", """
SELECT take_id, unnest(range(len(toks))) AS idx, unnest(toks) AS text FROM spoken_lists""")
part("steps", """
SELECT take_id, idx, text, 100 + 60 * least(length(text), 12) AS dur,
       CASE WHEN right(text, 1) IN ('.', '!', '?') THEN 500 + (idx * 37) % 900
            WHEN right(text, 1) IN (',', ';', ':') THEN 250 + (idx * 29) % 300
            WHEN idx % 17 = 0 THEN 300 + (idx * 13) % 400
            ELSE (idx * 7) % 60 END AS gap
FROM spoken""")
part("words", """
SELECT take_id, idx, text, start_ms, start_ms + dur AS end_ms FROM (
  SELECT *, cast(coalesce(sum(dur + gap) OVER (PARTITION BY take_id ORDER BY idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
  FROM steps)""")
part("media", """
SELECT take_id, cast(max(end_ms) + 1000 AS BIGINT) AS duration_ms,
       ([23.976, 25.0, 29.97, 30.0, 59.94])[take_id % 5 + 1]::DOUBLE AS fps,
       take_id % 7 <> 0 AS has_audio,
       CASE WHEN take_id % 7 <> 0 THEN take_id % 3 END AS channels,
       CASE WHEN take_id % 7 <> 0 THEN ([44100, 48000, 22050])[take_id % 3 + 1] END AS sample_rate,
       take_id % 2 = 0 AS measured,
       '/media/take & ' || take_id || '.mp4' AS file_name
FROM words GROUP BY take_id""")
part("gaps", """
SELECT *, coalesce(start_ms - lag(end_ms) OVER w, 0) AS gap_before,
       coalesce(lead(start_ms) OVER w - end_ms, 0) AS gap_after,
       lag(end_ms) OVER w AS prev_end, lag(start_ms) OVER w AS prev_start,
       lag(text) OVER w AS prev_raw
FROM words WINDOW w AS (PARTITION BY take_id ORDER BY idx)""")
part("silences", """
SELECT take_id, prev_end AS start_ms, start_ms AS end_ms FROM gaps
WHERE take_id % 2 = 0 AND prev_end IS NOT NULL AND start_ms - prev_end >= 300""")


def clean(x: str) -> str:
    edge = """[.,!?;:"''—–-]"""
    return (f"lower(regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'),"
            f" '^{edge}+|{edge}+$', '', 'g'))")


def norm(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'),"
            " '^\\s+|\\s+$', '', 'g')")


def two(ms: str) -> str:
    return (f"((({ms}) + 5) // 10) // 100 || '.' || "
            f"lpad(cast(((({ms}) + 5) // 10) % 100 AS VARCHAR), 2, '0')")


part("tokened", f"SELECT *, {clean('text')} AS token, {clean('prev_raw')} AS prev_token FROM gaps")
part("raw_gap", f"""
SELECT take_id, prev_end + 120 AS start_ms, start_ms - 120 AS end_ms, 'silence' AS reason,
       least(100, 60 + (gap_before - 400 + 10) // 20) AS confidence_pct,
       {two('gap_before')} || 's pause' AS text, true AS auto, 0 AS rnk, idx AS pos
FROM gaps WHERE gap_before >= 400 AND gap_before - 240 > 50""")
part("raw_sound", """
SELECT take_id, start_ms, end_ms, 'filler' AS reason, 100 AS confidence_pct, text, true AS auto,
       1 AS rnk, idx AS pos
FROM tokened WHERE token = 'er'""")
part("raw_repeat", r"""
SELECT take_id, prev_start AS start_ms, prev_end AS end_ms, 'repeat' AS reason,
       80 AS confidence_pct, prev_raw AS text, true AS auto, 2 AS rnk, idx AS pos
FROM tokened
WHERE prev_token <> '' AND token = prev_token
  AND NOT regexp_matches(prev_raw, '[.,!?;:।]\s*$')
  AND NOT contains(prev_raw, '-') AND NOT contains(text, '-')
  AND token NOT IN ('to', 'le') AND gap_before <= 350""")
part("medians", """
SELECT take_id, token, cast(median(end_ms - start_ms) AS DOUBLE) AS median_ms, count(*) AS said
FROM tokened GROUP BY take_id, token HAVING count(*) >= 2""")
part("lexical_words", """
SELECT take_id, idx, start_ms, end_ms, token, text, gap_before, gap_after,
       count(*) OVER (PARTITION BY take_id, token ORDER BY start_ms
                      RANGE BETWEEN 15000 PRECEDING AND 15000 FOLLOWING) AS nearby
FROM tokened WHERE token IN ('the', 'and', 'of', 'de', 'la', 'der', 'que')""")
part("scores", """
SELECT w.take_id, w.idx, w.start_ms, w.end_ms, w.token, w.text,
       least(100, CASE WHEN gap_before >= 250 THEN 35 ELSE 0 END
           + CASE WHEN gap_after >= 250 THEN 35 ELSE 0 END
           + CASE WHEN median_ms > 0 AND (end_ms - start_ms) * 10 >= median_ms * 16
                  THEN 20 ELSE 0 END
           + CASE WHEN nearby >= 4 THEN 15 ELSE 0 END) AS score
FROM lexical_words w LEFT JOIN medians m USING (take_id, token)""")
part("raw_lexical", """
SELECT take_id, start_ms, end_ms, 'filler' AS reason, score AS confidence_pct, text,
       score >= 70 AS auto, 1 AS rnk, idx AS pos FROM scores WHERE score >= 45""")
part("raw_cuts", """
SELECT * FROM raw_gap UNION ALL SELECT * FROM raw_sound UNION ALL SELECT * FROM raw_lexical
UNION ALL SELECT * FROM raw_repeat""")


def merged(raw: str, pad: int = 60) -> dict[str, str]:
    """Sub-queries `cuts` (merged) and its steps over the raw cuts named `raw`."""
    return {
        "padded_cuts": f"""
SELECT r.*, greatest(0, start_ms - {pad}) AS a, least(end_ms + {pad}, duration_ms) AS b
FROM {raw} r JOIN media USING (take_id)
WHERE least(end_ms + {pad}, duration_ms) > greatest(0, start_ms - {pad})""",
        "reached_cuts": """
SELECT *, max(b) OVER (PARTITION BY take_id, auto ORDER BY start_ms, rnk, pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM padded_cuts""",
        "island_cuts": """
SELECT *, sum(CASE WHEN pm IS NULL OR a > pm THEN 1 ELSE 0 END)
            OVER (PARTITION BY take_id, auto ORDER BY start_ms, rnk, pos) AS isl,
       row_number() OVER (PARTITION BY take_id, auto ORDER BY start_ms, rnk, pos) AS rn
FROM reached_cuts""",
        "cuts": """
SELECT take_id, auto, min(a) AS start_ms, max(b) AS end_ms,
       arg_max(reason, confidence_pct * 10000000 - rn) AS reason,
       arg_max(confidence_pct, confidence_pct * 10000000 - rn) AS confidence_pct,
       arg_max(text, confidence_pct * 10000000 - rn) AS text
FROM island_cuts GROUP BY take_id, auto, isl""",
    }


for _name, _body in merged("raw_cuts").items():
    part(_name, _body)

part("applied", "SELECT take_id, start_ms, end_ms FROM cuts WHERE auto")
part("reach", """
SELECT take_id, start_ms, end_ms, greatest(0, coalesce(max(end_ms) OVER (
         PARTITION BY take_id ORDER BY start_ms, end_ms
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pos FROM applied""")
part("kept", """
SELECT * FROM (
  SELECT r.take_id, pos AS start_ms, least(start_ms, duration_ms) AS end_ms
  FROM reach r JOIN media USING (take_id) WHERE start_ms > pos
  UNION ALL
  SELECT m.take_id, greatest(0, coalesce(max(a.end_ms), 0)), m.duration_ms
  FROM media m LEFT JOIN applied a USING (take_id) GROUP BY m.take_id, m.duration_ms)
WHERE end_ms - start_ms > 10""")
part("spans", """
SELECT take_id, start_ms, end_ms, row_number() OVER w - 1 AS seg,
       cast(sum(end_ms - start_ms) OVER w - (end_ms - start_ms) AS BIGINT) AS offset_ms
FROM kept WINDOW w AS (PARTITION BY take_id ORDER BY start_ms)""")
part("assigned", """
SELECT * FROM (
  SELECT w.take_id, w.idx, w.start_ms, w.end_ms, w.text, s.seg, s.offset_ms,
         s.start_ms AS s, s.end_ms AS e,
         row_number() OVER (PARTITION BY w.take_id, w.idx ORDER BY
             greatest(0, least(w.end_ms, s.end_ms) - greatest(w.start_ms, s.start_ms)) DESC,
             s.seg) AS rn
  FROM words w JOIN spans s ON w.take_id = s.take_id AND
       CASE WHEN w.end_ms <= w.start_ms THEN s.start_ms <= w.start_ms AND w.start_ms <= s.end_ms
            ELSE w.start_ms < s.end_ms AND w.end_ms > s.start_ms END) WHERE rn = 1""")
part("retimed", """
SELECT take_id, idx, text, seg, start_ms,
       CASE WHEN end_ms <= start_ms THEN start_ms + 80 ELSE end_ms END AS end_ms
FROM (SELECT take_id, idx, text, seg, offset_ms + greatest(0, start_ms - s) AS start_ms,
             offset_ms + least(e - s, end_ms - s) AS end_ms FROM assigned)""")
