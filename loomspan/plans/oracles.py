"""SQL of the independent engine that takes parameters."""

from __future__ import annotations

from ..params import BLOCK, SAMPLING_RATE, VadParams


def speech(frames: str, p: VadParams, rate: int = SAMPLING_RATE, ended: bool = True) -> str:
    """Speech segmentation, one recursive step a frame of ``frames`` (``rec_id, no, prob``); for the longest silence at the limit, and silences over 0.

    Recordings end behind their last frame; else their last interval is not told.
    """
    silence, gap, speech, pad = (int(p.samples(x, rate)) for x in (p.min_silence_duration_ms, p.min_silence_at_max_speech, p.min_speech_duration_ms, p.speech_pad_ms))
    last = f"UNION ALL SELECT rec_id, start, n * {BLOCK}, n * {BLOCK} FROM r WHERE open AND i = n - 1 AND n * {BLOCK} - start > {speech}" if ended else ""
    return f"""SELECT rec_id, k, greatest(0, start - CASE WHEN b < {2 * pad} THEN b // 2 ELSE {pad} END) AS start, least(total, "end" + CASE WHEN a < {2 * pad} THEN a // 2 ELSE {pad} END) AS "end" FROM (SELECT *, row_number() OVER w - 1 AS k, start - lag("end") OVER w AS b, lead(start) OVER w - "end" AS a FROM (
    WITH RECURSIVE f AS MATERIALIZED (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY no) - 1 AS i, prob AS p, no * {BLOCK} AS cur, count(*) OVER (PARTITION BY rec_id) AS n FROM {frames}),
    r AS (SELECT rec_id, -1::BIGINT AS i, n, false AS open, 0::BIGINT AS start, 0::BIGINT AS temp, []::STRUCT("at" BIGINT, len BIGINT)[] AS gaps, NULL::BIGINT AS s, NULL::BIGINT AS e FROM f WHERE i = 0
      UNION ALL SELECT rec_id, i, n, CASE WHEN opens THEN true WHEN hard OR shut THEN false ELSE open END, CASE WHEN opens THEN cur WHEN hard OR shut THEN 0 ELSE start END, CASE WHEN hard OR shut THEN 0 ELSE temp END, CASE WHEN hard OR shut THEN [] ELSE gaps END,
        CASE WHEN shut AND temp - start > {speech} OR hard THEN start ELSE s END, CASE WHEN hard THEN cur WHEN shut AND temp - start > {speech} THEN temp ELSE e END
      FROM (SELECT *, low AND cur - temp >= {silence} AS shut FROM (SELECT rec_id, i, n, cur, open, opens, hard, s, e, start, gaps, low, CASE WHEN low AND temp = 0 THEN cur ELSE temp END AS temp
      FROM (SELECT rec_id, i, n, cur, open, opens, hard, p < {p.low} AND open AND NOT hard AS low, CASE WHEN cut THEN best."at" + best.len ELSE start END AS start, CASE WHEN cut THEN 0 ELSE temp END AS temp, CASE WHEN cut THEN [] ELSE gaps END AS gaps, CASE WHEN cut THEN start END AS s, CASE WHEN cut THEN best."at" END AS e
      FROM (SELECT *, long AND len(gaps) > 0 AS cut, long AND len(gaps) = 0 AS hard, gaps[list_position(list_transform(gaps, lambda g: g.len), list_max(list_transform(gaps, lambda g: g.len)))] AS best
      FROM (SELECT f.rec_id, f.i, f.n, f.p, f.cur, r.open, r.start, f.p >= {p.threshold} AND NOT r.open AS opens, r.open AND f.cur - r.start > {p.longest(rate)} AS long, CASE WHEN f.p >= {p.threshold} THEN 0 ELSE r.temp END AS temp,
        CASE WHEN f.p >= {p.threshold} AND r.temp > 0 AND f.cur - r.temp > {gap} THEN list_append(r.gaps, {{'at': r.temp, 'len': f.cur - r.temp}}) ELSE r.gaps END AS gaps FROM r JOIN f ON f.rec_id = r.rec_id AND f.i = r.i + 1)))) x))
    SELECT rec_id, s AS start, e AS "end", {f"n * {BLOCK}" if ended else "1000000000000000"} AS total FROM r WHERE s IS NOT NULL {last}) WINDOW w AS (PARTITION BY rec_id ORDER BY start)){"" if ended else " WHERE a IS NOT NULL"}"""
