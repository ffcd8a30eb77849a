"""DuckDB SQL of the timeline queries, written from their definitions over the same tables."""

from __future__ import annotations

from ..functions.text import COMMON, STOPWORDS
from ..operators.contents import FLAG_NOTES

T0, H, D, M, S = 1704067200000000, 3_600_000_000, 86_400_000_000, 60_000_000, 1_000_000


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


CTE = {
    "pa": f"""
        SELECT media_id, occ_id, start_us, end_us, content_id, value,
               CASE WHEN value < 5 THEN 'blank' WHEN end_us - start_us < {30 * M} THEN 'short' ELSE 'stable' END AS state_kind
        FROM (SELECT user_id AS media_id, event_id AS occ_id, s AS start_us, value,
                     least(coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id), s + {4 * H}), s + {4 * H}) AS end_us,
                     CASE WHEN event_type <> 'error' THEN event_type END AS content_id
              FROM (SELECT *, epoch_us(ts) - {T0} AS s FROM events))""",
    "pb": f"""
        SELECT user_id AS media_id, event_id AS utt_id, epoch_us(ts) - {T0} + {6 * H} AS start_us,
               epoch_us(ts) - {T0} + {6 * H} + round(value * 100)::BIGINT * {S} AS end_us, event_type || props AS text
        FROM events WHERE event_type IN ('click', 'view')""",
    "pc": f"SELECT DISTINCT user_id AS media_id, {30 * D}::BIGINT AS duration_us FROM events",
    "pd": f"""
        SELECT o_custkey AS media_id, o_orderkey AS occ_id, s AS start_us, o_orderstatus AS content_id,
               coalesce(lead(s) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey), s + {D}) AS end_us
        FROM (SELECT *, epoch_us(o_orderdate) - {T0} AS s FROM orders)""",
    "pe": f"""
        SELECT o_custkey AS media_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) - {T0}) AS utt_id,
               epoch_us(l_shipdate) - {T0} AS start_us, epoch_us(l_shipdate) - {T0} + l_quantity::BIGINT * {D} AS end_us
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pf": """
        SELECT content_id, media_id, reading_order, text, CASE WHEN reading_order = 0 THEN 'heading' ELSE 'paragraph' END AS kind,
               CASE WHEN reading_order % 7 = 6 THEN 'application_ui' WHEN reading_order % 5 = 4 THEN 'material_context' ELSE 'material_body' END AS role
        FROM (SELECT doc_id AS content_id, source AS media_id, unnest(string_split(text, chr(10))) AS text,
                     unnest(range(len(string_split(text, chr(10))))) AS reading_order FROM documents)""",
    "pg": """
        SELECT label AS media_id, vec_id AS frame_id, vec_id * 50000 AS t_us,
               list_transform(embedding, lambda x: round((x::DOUBLE + 0.6) * 200)::INT) AS pixels FROM embeddings""",
    "ph": """
        SELECT doc_id AS target_ref, CASE WHEN quality = 0 AND toxic = 1 THEN 'vision:extraction_failed' WHEN quality = 0 THEN 'vision:truncated_output'
               WHEN toxic = 1 THEN 'asr:terms_not_on_screen' ELSE 'timeline:check' END AS reason,
               CASE WHEN quality = 1 THEN 'resolved' ELSE 'open' END AS review_status FROM labels""",
    "pi": f"SELECT l_returnflag AS status, l_linestatus AS model, l_suppkey AS frame_id, epoch_us(l_shipdate) - {T0} AS created_us FROM lineitem",
    "pj": f"""
        SELECT conv_id AS media_id, conv_id || '-' || turn AS utt_id, turn * {10 * S} AS start_us, turn * {10 * S} + {12 * S} AS end_us,
               text, role AS source FROM conversations""",
    "pairs": """
        SELECT o.media_id, occ_id, utt_id, least(o.end_us, u.end_us) - greatest(o.start_us, u.start_us) AS overlap_us, o.start_us AS os, o.end_us AS oe
        FROM pa o JOIN pb u ON o.media_id = u.media_id AND least(o.end_us, u.end_us) - greatest(o.start_us, u.start_us) > 0""",
    "al": "SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY overlap_us DESC, os, oe, occ_id) = 1 AS is_primary FROM pairs",
    "shows": "SELECT * EXCLUDE (content_id), CASE WHEN content_id IS NOT NULL THEN occ_id % (SELECT max(doc_id) + 1 FROM documents) END AS content_id FROM pa",
    "runs": """
        SELECT media_id, min(start_us) AS start_us, arg_max(end_us, o) AS end_us, count(*) AS members, isl,
               row_number() OVER (PARTITION BY media_id ORDER BY isl) AS run,
               bool_or(failed) AS any_failed, bool_or(why = 'not_attempted') AS any_na, bool_or(why = 'skipped_short') AS any_skip,
               arg_min(prev, o) AS before, arg_max(nxt, o) AS after
        FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us, occ_id) AS o,
                     CASE WHEN failed THEN 'failed' WHEN state_kind = 'blank' THEN 'blank' WHEN state_kind = 'short' THEN 'skipped_short' ELSE 'not_attempted' END AS why
              FROM (SELECT pa.*, sum(CASE WHEN content_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_us, end_us, occ_id) AS isl,
                           lag(content_id) OVER (PARTITION BY media_id ORDER BY start_us, end_us, occ_id) AS prev,
                           lead(content_id) OVER (PARTITION BY media_id ORDER BY start_us, end_us, occ_id) AS nxt,
                           occ_id IN (SELECT target_ref FROM ph WHERE reason = 'vision:extraction_failed') AS failed FROM pa)
              WHERE content_id IS NULL)
        GROUP BY media_id, isl""",
    "gap": f"""
        SELECT * EXCLUDE (isl), CASE WHEN reason = 'blank' THEN 0.0 ELSE
                 least(duration_us / 10000000, 3.0) + least(speech_chars / 500, 3.0) + CASE WHEN neighbours_differ THEN 2.0 ELSE 0.0 END
                 + CASE reason WHEN 'failed' THEN 3.0 WHEN 'not_attempted' THEN 1.0 ELSE 0.0 END END AS score
        FROM (SELECT r.media_id, r.isl, r.start_us, r.end_us, r.end_us - r.start_us AS duration_us, any_value(members) AS members, any_value(reason) AS reason,
                     count(u.utt_id) AS utterances, coalesce(sum(length(u.text)), 0)::BIGINT AS speech_chars,
                     coalesce(any_value(before) <> any_value(after), false) AS neighbours_differ
              FROM (SELECT *, CASE WHEN any_failed THEN 'failed' WHEN any_na THEN 'not_attempted' WHEN NOT any_skip THEN 'blank' ELSE 'skipped_short' END AS reason FROM runs) r
              LEFT JOIN pb u ON r.media_id = u.media_id AND least(r.end_us, u.end_us) - greatest(r.start_us, u.start_us) > 0
              GROUP BY r.media_id, r.isl, r.start_us, r.end_us)
        WHERE NOT (duration_us < 2000000 AND reason = 'skipped_short')""",
    "spans": """
        SELECT media_id, occ_id, start_us, end_us, CASE WHEN content_id IS NOT NULL THEN 'extracted' WHEN state_kind = 'blank' THEN 'blank'
               WHEN state_kind = 'short' THEN 'unextracted' WHEN f.target_ref IS NOT NULL THEN 'failed' ELSE 'unextracted' END AS state
        FROM pa LEFT JOIN ph f ON f.target_ref = occ_id AND f.reason IN ('vision:extraction_failed', 'vision:truncated_output')""",
    "holes": """
        SELECT media_id, c AS start_us, start_us AS end_us FROM (
            SELECT media_id, start_us, greatest(0, coalesce(max(end_us) OVER (PARTITION BY media_id ORDER BY start_us, end_us, occ_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS c FROM pa)
        WHERE start_us > c
        UNION ALL
        SELECT pc.media_id, greatest(0, coalesce(e, 0)), duration_us FROM pc LEFT JOIN (SELECT media_id, max(end_us) AS e FROM pa GROUP BY 1) USING (media_id) WHERE duration_us > coalesce(e, 0)""",
    "body": "SELECT item_id AS content_id, text AS body_text FROM benchmark",
    "tocc": "SELECT * EXCLUDE (content_id), content_id % (SELECT max(item_id) + 1 FROM benchmark) AS content_id FROM shows",
    "talk": f"""
        SELECT conv_id % 97 AS media_id, conv_id || '-' || turn AS utt_id, (conv_id * 37 + turn) % 700 * {H} AS start_us,
               (conv_id * 37 + turn) % 700 * {H} + {12 * S} AS end_us, text FROM conversations""",
    "shown": f"""
        SELECT media_id, start_us, end_us, term FROM tocc JOIN (
            SELECT DISTINCT content_id, lower(f) AS term FROM (SELECT content_id, unnest(regexp_extract_all(body_text, '[A-Za-z][A-Za-z0-9_.\\-]{{3,}}')) AS f FROM body)
            WHERE lower(f) NOT IN ({_in(COMMON)})) USING (content_id)""",
    "forms": "SELECT *, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.\\-]{3,}')) AS f FROM talk",
    "said": f"""
        SELECT media_id, utt_id, start_us, end_us, lower(f) AS term, bool_or(regexp_matches(f, '[_.\\-0-9]|[a-z][A-Z]')) AS technical
        FROM forms WHERE lower(f) NOT IN ({_in(COMMON)}) GROUP BY ALL""",
    "verdicts": f"""
        SELECT s.utt_id, s.term, CASE WHEN bool_or(v.term IS NOT NULL AND least(v.end_us, s.end_us + 120 * {S}) - greatest(v.start_us, s.start_us - 120 * {S}) > 0) THEN 'confirmed'
                                  WHEN count(v.term) > 0 THEN 'elsewhere' ELSE 'not_found' END AS verdict
        FROM said s LEFT JOIN shown v ON v.media_id = s.media_id AND v.term = s.term GROUP BY s.utt_id, s.term, s.technical HAVING s.technical OR count(v.term) > 0""",
    "chunks": f"""
        SELECT media_id, i AS chunk, cs AS core_start_us, least(e, cs + {600 * S}) AS core_end_us, greatest({5 * S}, cs - {2 * S}) AS start_us,
               least({5 * S} + {4 * H}, least(e, cs + {600 * S}) + {2 * S}) AS end_us
        FROM (SELECT media_id, e, i, greatest(media_id * {S}, {5 * S}) + i * {600 * S} AS cs
              FROM (SELECT media_id, media_id % 7 * {H} + {H} AS e FROM pc), range(0, 60) t(i))
        WHERE cs < e AND least({5 * S} + {4 * H}, least(e, cs + {600 * S}) + {2 * S}) > greatest({5 * S}, cs - {2 * S})""",
    "lagged": "SELECT *, lag(pixels) OVER (PARTITION BY media_id ORDER BY t_us) AS before, lead(pixels) OVER (PARTITION BY media_id ORDER BY t_us) AS after FROM pg",
    "docpairs": "SELECT * FROM (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) WHERE before IS NOT NULL",
}
STAMP = "{sign} || (abs({x}) // 3600000000) || ':' || lpad((abs({x}) // 60000000 % 60)::VARCHAR, 2, '0') || ':' || lpad((abs({x}) // 1000000 % 60)::VARCHAR, 2, '0')"


def _stamp(x: str, ms: bool = True) -> str:
    out = STAMP.format(sign=f"CASE WHEN {x} < 0 THEN '-' ELSE '' END", x=x)
    return out + (f" || '.' || lpad((abs({x}) // 1000 % 1000)::VARCHAR, 3, '0')" if ms else "")


def _srt(x: str) -> str:
    x = f"greatest(0, {x})"
    pad = lambda v, n: f"lpad(({v})::VARCHAR, greatest({n}, length(({v})::VARCHAR))::INT, '0')"
    return f"{pad(f'{x} // 3600000000', 2)} || ':' || {pad(f'{x} // 60000000 % 60', 2)} || ':' || {pad(f'{x} // 1000000 % 60', 2)} || ',' || {pad(f'{x} // 1000 % 1000', 3)}"


LINES = "list_distinct(list_filter(list_transform(string_split({x}, chr(10)), lambda y: trim(y)), lambda y: y <> ''))"
LARGE = "SELECT pd.content_id, count(*) AS pairs, sum(least(pd.end_us, pe.end_us) - greatest(pd.start_us, pe.start_us))::BIGINT AS overlap_us, count(DISTINCT utt_id) AS utterances FROM pd JOIN pe ON pd.media_id = pe.media_id AND least(pd.end_us, pe.end_us) - greatest(pd.start_us, pe.start_us) > 0 GROUP BY 1"
ORDER = "(PARTITION BY media_id ORDER BY start_us, end_us, occ_id)"

BODY = {
    "scan_occurrences": "SELECT media_id, occ_id, start_us, end_us, content_id, state_kind FROM pa",
    "scan_utterances": "SELECT * FROM pb",
    "scan_coverage_track": "SELECT media_id, start_us, end_us, state FROM spans WHERE state = 'extracted'",
    "lookup_by_key": "SELECT media_id, occ_id, start_us FROM pa WHERE media_id = 7",
    "oldest_media": "SELECT media_id, min(start_us) AS first_us FROM pa GROUP BY 1 ORDER BY 2, 1 LIMIT 1",
    "range_clip": f"SELECT media_id, {5 * D} AS range_start_us, least(duration_us, {40 * D}) AS range_end_us FROM pc WHERE duration_us > {5 * D}",
    "state_kind": "SELECT occ_id, state_kind AS kind FROM pa",
    "extractable_states": f"SELECT occ_id, state_kind FROM pa WHERE state_kind <> 'blank' AND end_us - start_us >= {H}",
    "body_text": "SELECT content_id, sha256(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY reading_order) FILTER (role = 'material_body'), '')) AS body_sha, count(*) AS n_regions FROM pf GROUP BY 1",
    "referenced_contents": "SELECT doc_id AS content_id FROM documents WHERE doc_id IN (SELECT content_id FROM shows)",
    "superseded_contents": "SELECT doc_id AS content_id FROM documents WHERE doc_id NOT IN (SELECT content_id FROM shows WHERE content_id IS NOT NULL)",
    "time_anomalies": f"""SELECT 'occurrence' AS kind, occ_id::VARCHAR AS id, 'inverted' AS problem FROM pa WHERE end_us < start_us
        UNION ALL SELECT 'occurrence', occ_id::VARCHAR, 'outside' FROM pa WHERE start_us < 0 OR end_us > {28 * D}
        UNION ALL SELECT 'utterance', utt_id::VARCHAR, 'inverted' FROM pb WHERE end_us < start_us
        UNION ALL SELECT 'utterance', utt_id::VARCHAR, 'outside' FROM pb WHERE start_us < 0 OR end_us > {28 * D} + {S}""",
    "coverage_state": "SELECT occ_id, state FROM spans",
    "open_reviews_by_prefix": "SELECT * FROM ph WHERE starts_with(reason, 'vision:') AND review_status = 'open'",
    "topk_regions": """SELECT * FROM (SELECT content_id, reading_order, length(text) AS area, role = 'material_context' AS uncertain,
        row_number() OVER (PARTITION BY content_id ORDER BY role = 'material_context' DESC, length(text) DESC, reading_order) AS rank FROM pf) WHERE rank <= 3""",
    "region_roles": "SELECT role, kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM pf GROUP BY ALL",
    "align_overlap": "SELECT media_id, occ_id, utt_id, overlap_us FROM pairs",
    "align_primary": "SELECT utt_id, occ_id, overlap_us FROM al WHERE is_primary",
    "align_large": LARGE,
    "align_large_bucketed": LARGE,
    "orphan_utterances": "SELECT media_id, utt_id FROM pb WHERE utt_id NOT IN (SELECT utt_id FROM pairs)",
    "silent_occurrences": "SELECT media_id, occ_id FROM pa WHERE occ_id NOT IN (SELECT occ_id FROM pairs)",
    "alignment_table": """SELECT pa.media_id, pa.occ_id, pa.start_us, pa.end_us, pa.content_id, al.utt_id, overlap_us, is_primary,
        pb.start_us AS utt_start_us, pb.end_us AS utt_end_us, text FROM pa LEFT JOIN al ON al.occ_id = pa.occ_id LEFT JOIN pb ON pb.utt_id = al.utt_id""",
    "alignments_for_media": "SELECT occ_id, utt_id, overlap_us FROM pairs WHERE media_id BETWEEN 3 AND 9",
    "utterance_refs": "SELECT pb.utt_id, string_agg(occ_id, ',' ORDER BY occ_id) AS occ_ids, max(occ_id) FILTER (is_primary) AS primary_occ_id FROM pb LEFT JOIN al USING (utt_id) GROUP BY 1",
    "occ_with_content": "SELECT occ_id, content_id, sha256(text) AS text_hash FROM shows LEFT JOIN documents ON doc_id = content_id",
    "nearby_terms": f"SELECT utt_id, count(DISTINCT term) AS terms FROM shown s JOIN talk u ON s.media_id = u.media_id AND least(s.end_us, u.end_us + 120 * {S}) - greatest(s.start_us, u.start_us - 120 * {S}) > 0 GROUP BY 1",
    "term_match": "SELECT * FROM verdicts",
    "unverified_terms": "SELECT * FROM (SELECT term, count(*) AS n FROM verdicts WHERE verdict = 'not_found' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30) WHERE n >= 2",
    "screen_vocab": f"SELECT DISTINCT lower(f) AS term FROM (SELECT unnest(regexp_extract_all(body_text, '[A-Za-z][A-Za-z0-9_.\\-]{{3,}}')) AS f FROM body) WHERE lower(f) NOT IN ({_in(COMMON)})",
    "spoken_terms": f"""SELECT utt_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.\\-]{{3,}}'),
        lambda x: lower(x) NOT IN ({_in(COMMON)}) AND regexp_matches(x, '[_.\\-0-9]|[a-z][A-Z]')), lambda x: lower(x)))), ' ') AS terms FROM pj""",
    "term_index": f"""
        SELECT term, surface, shown, sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::BIGINT AS said, first_us
        FROM (SELECT term, sum(n)::BIGINT AS shown, min(first_us) AS first_us, first(form ORDER BY n DESC, form) AS surface
              FROM (SELECT lower(form) AS term, form, count(*) AS n, min(start_us) AS first_us
                    FROM tocc JOIN (SELECT DISTINCT content_id, form FROM (SELECT content_id, unnest(regexp_extract_all(body_text, '[A-Za-z][A-Za-z0-9_.\\-]{{2,}}')) AS form FROM body)
                                    WHERE length(form) >= 4 AND lower(form) NOT IN ({_in(STOPWORDS)}) AND (regexp_matches(form, '[_.\\-0-9]|[a-z][A-Z]') OR regexp_matches(form, '^[A-Z]'))) USING (content_id)
                    GROUP BY ALL) GROUP BY term ORDER BY shown DESC, term LIMIT 300), talk
        GROUP BY term, surface, shown, first_us HAVING said > 0""",
    "events_in_block": """SELECT r.media_id, r.run AS block_index, p.occ_id, 'pointer' AS event_kind FROM runs r JOIN pa p ON p.media_id = r.media_id
        AND p.start_us >= r.start_us AND p.end_us <= r.end_us WHERE p.occ_id % 5 <> 0""",
    "utt_in_silence": """SELECT utt_id, silent_us FROM (SELECT utt_id, sum(least(r.end_us, u.end_us) - greatest(r.start_us, u.start_us))::BIGINT AS silent_us, any_value(u.end_us - u.start_us) AS d
        FROM pb u JOIN runs r ON r.media_id = u.media_id AND least(r.end_us, u.end_us) - greatest(r.start_us, u.start_us) > 0 GROUP BY utt_id) WHERE silent_us / greatest(1, d) > 0.9""",
    "failed_occurrences": "SELECT occ_id, media_id FROM pa WHERE occ_id IN (SELECT target_ref FROM ph WHERE reason = 'vision:extraction_failed')",
    "resume_pending": "SELECT occ_id FROM pa WHERE occ_id NOT IN (SELECT doc_id FROM labels)",
    "cache_misses": """WITH w AS (SELECT occ_id, sha256(concat_ws(chr(31), media_id, content_id, 'v1')) AS cache_key FROM pa WHERE content_id IS NOT NULL)
        SELECT * FROM w WHERE cache_key NOT IN (SELECT cache_key FROM w WHERE occ_id % 3 = 0)""",
    "block_utterances": """SELECT r.media_id, r.run, string_agg(u.utt_id, ',' ORDER BY u.start_us, u.utt_id) AS utt_ids FROM runs r JOIN pb u ON r.media_id = u.media_id
        AND least(r.end_us, u.end_us) - greatest(r.start_us, u.start_us) > 0 GROUP BY ALL""",
    "attempt_stats": "SELECT status, count(*) AS n FROM pi GROUP BY 1",
    "provenance": "SELECT status, model, frame_id, count(*) AS n, min(created_us) AS first_us, max(created_us) AS last_us FROM pi GROUP BY ALL",
    "speech_sources": "SELECT DISTINCT source FROM pj",
    "coverage_by_state": """SELECT 'screen' AS track, state, sum(greatest(0, end_us - start_us))::BIGINT AS covered_us
        FROM (SELECT start_us, end_us, state FROM spans UNION ALL SELECT start_us, end_us, 'unextracted' FROM holes) GROUP BY ALL""",
    "quality_scorecard": """
        SELECT 'occurrences' AS measure, count(*) AS value FROM shows UNION ALL SELECT 'occurrences_extracted', count(content_id) FROM shows
        UNION ALL SELECT 'occurrences_unextracted', count(*) FROM shows WHERE content_id IS NULL
        UNION ALL SELECT 'short_states', count(*) FROM shows WHERE state_kind = 'short'
        UNION ALL SELECT 'short_states_unextracted', count(*) FROM shows WHERE state_kind = 'short' AND content_id IS NULL
        UNION ALL SELECT 'unique_contents', count(*) FROM documents WHERE doc_id IN (SELECT content_id FROM shows)
        UNION ALL SELECT 'superseded_contents', count(*) FROM documents WHERE doc_id NOT IN (SELECT content_id FROM shows WHERE content_id IS NOT NULL)
        UNION ALL SELECT 'utterances', count(*) FROM pb UNION ALL SELECT 'utterances_unaligned', count(*) FROM pb WHERE utt_id NOT IN (SELECT utt_id FROM pairs)
        UNION ALL SELECT 'alignments', count(*) FROM pairs UNION ALL SELECT 'reviews_total', count(*) FROM ph
        UNION ALL SELECT 'reviews_open', count(*) FROM ph WHERE review_status = 'open'""",
    "reviews_by_reason": "SELECT reason, count(*) AS n FROM ph GROUP BY 1",
    "gaps": "SELECT * REPLACE (round(score, 6) AS score) FROM gap",
    "gap_summary": "SELECT reason, count(*) AS gaps, sum(duration_us)::BIGINT AS duration_us, count(*) FILTER (utterances > 0) AS with_speech, count(*) FILTER (neighbours_differ) AS neighbours_differ FROM gap GROUP BY 1",
    "gaps_top": "SELECT media_id, start_us, reason, round(score, 6) AS score FROM gap ORDER BY gap.score DESC, start_us, media_id LIMIT 20",
    "align_stats": """SELECT (SELECT count(*) FROM pa) AS occurrences, (SELECT count(*) FROM pb) AS utterances, count(*) AS alignments, count(*) FILTER (is_primary) AS primaries,
        (SELECT count(*) FROM pb) - count(DISTINCT utt_id) AS orphans, (SELECT count(*) FROM pa) - count(DISTINCT occ_id) AS silent FROM al""",
    "timestamp_check": f"""
        WITH d AS (SELECT user_id % 50 AS media_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS d FROM events),
        m AS (SELECT media_id, list_sort(list(d) FILTER (d > 0)) AS l FROM d GROUP BY 1)
        SELECT d.media_id, count(*) AS stamps, count(*) FILTER (d <= 0) AS non_monotonic, any_value(l[len(l) // 2 + 1]) AS median_us,
               count(*) FILTER (d > 3 * l[len(l) // 2 + 1]) AS gaps FROM d JOIN m USING (media_id) GROUP BY 1""",
    "content_dedup": "SELECT min(doc_id) AS content_id, sha256(text) AS text_hash, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
    "pixel_stats": """SELECT frame_id, list_sum(list_transform(list_zip(pixels, before), lambda z: CASE WHEN abs(z[1] - z[2]) > 18 THEN 1 ELSE 0 END))::INT AS changed,
        round(list_stddev_pop(pixels), 6) AS spread, round(list_avg(list_transform(list_zip(pixels, before), lambda z: abs(z[1] - z[2]))), 6) AS difference FROM lagged WHERE before IS NOT NULL""",
    "tile_counts": """SELECT frame_id, (i // 8) // 4 AS tile_row, i % 8 // 2 AS tile_col, sum(CASE WHEN abs(pixels[i + 1] - before[i + 1]) > 18 THEN 1 ELSE 0 END)::BIGINT AS changed
        FROM lagged, range(64) t(i) WHERE before IS NOT NULL GROUP BY ALL""",
    "merge_states": f"""
        SELECT media_id, arg_min(occ_id, o) AS occ_id, min(start_us) AS start_us, arg_max(end_us, o) AS end_us, any_value(content_id) AS content_id,
               arg_min(state_kind, o) AS state_kind, count(*) AS members, count(*) - 1 AS absorbed
        FROM (SELECT *, sum(b) OVER {ORDER} AS isl FROM (
            SELECT *, row_number() OVER {ORDER} AS o, CASE WHEN content_id = lag(content_id) OVER {ORDER} AND start_us <= lag(end_us) OVER {ORDER} THEN 0 ELSE 1 END AS b FROM pa))
        GROUP BY media_id, isl""",
    "change_events": f"SELECT media_id, occ_id, start_us FROM (SELECT *, content_id = lag(content_id) OVER {ORDER} AND start_us <= lag(end_us) OVER {ORDER} AS a FROM pa) WHERE a",
    "merge_deferred": f"""SELECT media_id, count(*) FILTER (h) AS deferred FROM (
        SELECT media_id, content_id IS NOT NULL AND lead(content_id) OVER {ORDER} IS NULL AND lead(start_us) OVER {ORDER} <= end_us AS h FROM pa) GROUP BY 1""",
    "unextracted_runs": "SELECT media_id, start_us, end_us, members, run FROM runs",
    "run_kinds": "SELECT media_id, state_kind, count(*) AS n FROM pa WHERE content_id IS NULL GROUP BY ALL",
    "coverage_gaps": "SELECT * FROM holes",
    "coverage_fill": "SELECT media_id, start_us, end_us, state FROM spans UNION ALL SELECT media_id, start_us, end_us, 'unextracted' FROM holes",
    "bursts": f"""
        SELECT occ_id, sh AND n >= 3 AND rn < n AS burst, CASE WHEN sh AND n >= 3 AND rn < n THEN 'transition' ELSE state_kind END AS new_kind
        FROM (SELECT *, count(*) OVER (PARTITION BY media_id, isl) AS n, row_number() OVER (PARTITION BY media_id, isl ORDER BY start_us, end_us, occ_id) AS rn
              FROM (SELECT *, sum(CASE WHEN sh AND psh THEN 0 ELSE 1 END) OVER {ORDER} AS isl
                    FROM (SELECT *, lag(sh) OVER {ORDER} AS psh FROM (SELECT *, end_us - start_us <= {2 * H} AS sh FROM pa))))""",
    "silence_spans": f"""
        SELECT media_id, min(w) * 20000 AS start_us, (max(w) + 1) * 20000 AS end_us
        FROM (SELECT media_id, w, w - row_number() OVER (PARTITION BY media_id ORDER BY w) AS isl
              FROM (SELECT user_id % 20 AS media_id, value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS w FROM events) WHERE value - 60 < -45)
        GROUP BY media_id, isl HAVING count(*) * 20000 >= 60000""",
    "chunk_plan": "SELECT * FROM chunks",
    "chunk_owner": f"""
        WITH s AS (SELECT conv_id % 100 AS media_id, conv_id || '-' || turn AS utt_id, (conv_id * 7919 + turn * 10000) % 14400 * {S} AS a FROM conversations),
        l AS (SELECT media_id, max(chunk) AS l FROM chunks GROUP BY 1)
        SELECT s.media_id, c.chunk, s.utt_id FROM s JOIN chunks c ON c.media_id = s.media_id AND a + {12 * S} > c.start_us AND a < c.end_us JOIN l ON l.media_id = s.media_id
        WHERE (a + {6 * S} >= core_start_us AND a + {6 * S} < core_end_us) OR (c.chunk = 0 AND a + {6 * S} < core_start_us) OR (c.chunk = l AND a + {6 * S} >= core_end_us)""",
    "screen_versions": f"""SELECT media_id, occ_id, content_id FROM (SELECT *, lag(content_id) OVER {ORDER} AS p FROM pa WHERE content_id IS NOT NULL) WHERE p IS NULL OR p <> content_id""",
    "line_diff": """
        WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS n, string_split(before, chr(10)) AS w FROM docpairs),
        c AS (SELECT doc_id, list_filter(n, lambda x: trim(x) <> '' AND NOT list_contains(w, x)) AS a, list_filter(w, lambda x: trim(x) <> '' AND NOT list_contains(n, x)) AS r FROM p)
        SELECT doc_id, len(a) AS added, len(r) AS removed, sha256(coalesce(array_to_string(list_transform(a[1:3], lambda x: substring(x, 1, 60)), ' / '), '')) AS added_sha FROM c""",
    "material_similarity": f"""
        WITH p AS (SELECT doc_id, {LINES.format(x="text")} AS a, {LINES.format(x="before")} AS b FROM docpairs)
        SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity FROM p""",
    "cache_evict": """SELECT frame_id, freed_before FROM (
        SELECT event_id AS frame_id, coalesce(sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id % 10 ORDER BY event_id % 4, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM events)
        WHERE freed_before < 200000""",
    "cache_priority": """SELECT occ_id // 3 AS frame_id, max(CASE WHEN occ_id IN (SELECT target_ref FROM ph WHERE review_status = 'open') THEN 100 ELSE 0 END
        + CASE WHEN content_id IS NULL THEN 50 ELSE 0 END + CASE WHEN state_kind = 'short' THEN 20 ELSE 0 END) AS priority FROM pa GROUP BY 1""",
    "flag_merge": """SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['not_extracted', 't' || toxic], list_filter(['not_extracted', 'q' || quality], lambda x: x <> 'q1')))), ',') AS flags FROM labels""",
    "fmt_ts": f"SELECT occ_id, {_stamp('start_us')} AS stamp, {_stamp('(-start_us)', False)} AS negative FROM pa",
    "fmt_srt": f"SELECT occ_id, {_srt(f'(start_us - {D})')} AS stamp FROM pa",
    "pts_to_us": "SELECT occ_id, (occ_id * 1001 * 2000000 + 30000) // 60000 - 33 AS t_us FROM pa",
    "content_hash": """SELECT content_id, sha256('slide' || chr(29) || string_agg(kind || chr(31) || trim(text), chr(30) ORDER BY reading_order)) AS text_hash
        FROM pf WHERE role <> 'application_ui' GROUP BY 1""",
    "context_key": "SELECT content_id, arg_min(trim(text), reading_order) AS heading FROM pf WHERE kind = 'heading' AND trim(text) <> '' GROUP BY 1",
    "clamp_bbox": """
        WITH p AS (SELECT p_partkey, p_size / 60 * 960 AS xr, p_size / 60 / 2 * 960 AS xl, p_partkey % 97 / 100 * 540 AS yt, (p_partkey % 97 / 100 + 0.125) * 540 AS yb FROM part),
        q AS (SELECT p_partkey, floor(greatest(0, xl - (xr - xl) * 0.5 - 4))::INT AS x0, floor(greatest(0, yt - (yb - yt) * 0.5 - 4))::INT AS y0,
                     floor(least(960, xr + (xr - xl) * 0.5 + 4))::INT AS x1, floor(least(540, yb + (yb - yt) * 0.5 + 4))::INT AS y1 FROM p)
        SELECT p_partkey, x0, y0, CASE WHEN x1 <= x0 THEN least(960, x0 + 1) ELSE x1 END AS x1, CASE WHEN y1 <= y0 THEN least(540, y0 + 1) ELSE y1 END AS y1 FROM q""",
    "tile_plan": """SELECT p_partkey, k * 902 AS y0, least(p_size * 100, k * 902 + 1100) AS y1 FROM part, range(0, 10) t(k)
        WHERE k = 0 OR (k - 1) * 902 + 1100 < p_size * 100""",
    "md_escape": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '([\\`*_\[\]<>|])', '\\\1', 'g'), '(?m)^([^\S\n]*)([#\-+=]|\d+[.)])', '\1\\\2', 'g')) AS escaped_sha,
        repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)) AS fence FROM documents""",
    "patch_similarity": "SELECT frame_id, round(list_avg(list_transform(list_zip(pixels, after), lambda z: abs(z[1] - z[2]))), 6) AS difference FROM lagged WHERE after IS NOT NULL",
    "substring_counts": "SELECT utt_id, (length(lower(text)) - length(replace(lower(text), 'th', ''))) // 2 AS n FROM pj",
    "srt_cues": f"""SELECT media_id, cue, utt_id, sha256(cue || chr(10) || {_srt('start_us')} || ' --> ' || {_srt('greatest(end_us, start_us + 1000)')} || chr(10) || trim(regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g')) || chr(10)) AS block_sha
        FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_us, end_us, utt_id) AS cue FROM pj)""",
    "review_items": """SELECT 'occurrence' AS target_kind, occ_id::VARCHAR AS target_ref, 'timeline:outside' AS reason FROM pa JOIN pc USING (media_id) WHERE end_us > duration_us
        UNION ALL SELECT 'occurrence', occ_id::VARCHAR, 'vision:not_extracted' FROM pa WHERE content_id IS NULL AND state_kind = 'stable'
        UNION ALL SELECT 'utterance', utt_id::VARCHAR, 'asr:empty_interval' FROM pb WHERE end_us <= start_us""",
    "quality_notes": """SELECT unit, flag, array_to_string(list_sort(list(DISTINCT content_id))[1:3], ', ') AS content_ids FROM (
        SELECT source AS unit, doc_id AS content_id, CASE WHEN quality = 0 THEN 'truncated' WHEN toxic = 1 THEN 'unreadable' ELSE 'duplicate_regions_removed' END AS flag
        FROM documents JOIN labels USING (doc_id)) WHERE flag <> 'duplicate_regions_removed' GROUP BY ALL""",
    "utterance_rows": f"""SELECT pb.utt_id, {_stamp('start_us')} AS start, {_stamp('end_us')} AS end, any_value(text) AS text, coalesce(string_agg(occ_id, ',' ORDER BY occ_id), '') AS occ_ids
        FROM pb LEFT JOIN al USING (utt_id) GROUP BY pb.utt_id, start_us, end_us""",
    "upserted_rows": """SELECT occ_id, CASE WHEN state_kind = 'short' THEN 'transition' ELSE state_kind END AS state_kind FROM pa
        UNION ALL SELECT -occ_id - 1, 'new' FROM pa WHERE state_kind = 'blank'""",
    "replaced_scopes": f"""SELECT media_id, start_us, end_us, state FROM spans WHERE media_id NOT IN (SELECT media_id FROM pa WHERE state_kind = 'blank')
        UNION ALL SELECT DISTINCT media_id, 0, {D}, 'unextracted' FROM pa WHERE state_kind = 'blank'""",
    "cascaded_rows": "SELECT target_ref, reason, review_status FROM ph WHERE target_ref IN (SELECT occ_id FROM pa WHERE content_id IS NOT NULL)",
    "orphan_references": "SELECT DISTINCT target_ref FROM ph WHERE target_ref NOT IN (SELECT occ_id FROM pa WHERE content_id IS NOT NULL)",
    "cleared_reviews": "SELECT target_ref, reason, review_status FROM ph WHERE NOT (starts_with(reason, 'vision:') AND review_status = 'open')",
    "constraint_checks": f"""SELECT 'ordered' AS rule, count(*) FILTER (end_us < start_us) AS violations FROM pa UNION ALL SELECT 'later', count(*) FILTER (start_us <= {D}) FROM pa
        UNION ALL SELECT 'shown', count(*) FILTER (content_id IS NULL) FROM pa""",
    "status_counts": """SELECT (SELECT count(*) FROM pa) AS occurrences, (SELECT count(content_id) FROM pa) AS extracted, (SELECT count(*) FROM pb) AS utterances,
        (SELECT count(*) FROM ph WHERE review_status = 'open') AS open_reviews""",
    "role_lists": """SELECT content_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY reading_order) FILTER (role = 'material_body'), '')) AS body_sha,
        sha256(coalesce(string_agg(text, chr(10) ORDER BY reading_order) FILTER (role = 'material_context'), '')) AS context_sha,
        sha256(coalesce(string_agg(text, chr(10) ORDER BY reading_order) FILTER (role = 'application_ui'), '')) AS other_sha, sha256('') AS captions_sha FROM pf GROUP BY 1""",
    "shown_metrics": """
        WITH m AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS stage, 'price' AS name, l_extendedprice::DOUBLE AS value, 'x' AS unit FROM lineitem
                   UNION ALL SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey), 'count', l_quantity::DOUBLE, '' FROM lineitem)
        SELECT stage, name, CASE WHEN abs(value - trunc(value)) <= 1e-9 THEN trunc(value)::BIGINT::VARCHAR ELSE printf('%.3f', value) END || unit AS shown FROM m""",
    "change_kinds": "SELECT occ_id, CASE WHEN value < 5 THEN 'repeat' WHEN value < 20 THEN 'modified' WHEN content_id IS NULL THEN 'unextracted' ELSE 'first' END AS kind FROM pa",
    "attempts_of_frame": "SELECT frame_id, created_us, status, model FROM pi WHERE frame_id = 7",
    "contained_spans": "SELECT pd.occ_id, count(*) AS inside FROM pd JOIN pa ON pd.media_id = pa.media_id AND pa.start_us >= pd.start_us AND pa.end_us <= pd.end_us GROUP BY 1",
    "utterances_or_none": """SELECT pa.occ_id, utt_id, CASE WHEN utt_id IS NOT NULL THEN least(pa.end_us, pb.end_us) - greatest(pa.start_us, pb.start_us) END AS overlap_us
        FROM pa LEFT JOIN pb ON pa.media_id = pb.media_id AND least(pa.end_us, pb.end_us) > greatest(pa.start_us, pb.start_us)""",
    "full_image_sizes": """
        WITH p AS (SELECT p_partkey, p_size * 100 AS w, p_partkey % 97 * 40 + 1 AS h, p_size * 9 AS cw, p_size * 3 AS ch FROM part),
        q AS (SELECT *, CASE WHEN greatest(w, h) <= 2048 THEN 1.0::DOUBLE ELSE 2048.0::DOUBLE / greatest(w, h) END AS k,
                     CASE WHEN ch < 96 THEN least(3.0::DOUBLE, 96.0::DOUBLE / greatest(1, ch)) ELSE 1.0::DOUBLE END AS f FROM p),
        r AS (SELECT *, CASE WHEN cw * ch * f * f > 20000 THEN greatest(1.0::DOUBLE, sqrt(20000.0::DOUBLE / (cw * ch))) ELSE f END AS g FROM q)
        SELECT p_partkey, trunc(w * k)::INT AS width, trunc(h * k)::INT AS height, round(k, 6) AS scale, round(CASE WHEN g <= 1.001 THEN 1.0::DOUBLE ELSE g END, 6) AS factor FROM r""",
    "audio_mismatches": """
        WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT * 100000 AS made,
                          CASE WHEN l_linenumber > 2 THEN l_linenumber * 700000 WHEN l_linenumber > 1 THEN l_linenumber * 700000 - 50000 END::BIGINT AS expected_us FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, expected_us, made - expected_us AS diff_us, coalesce(abs(made - expected_us) > 200000, false) AS mismatch FROM p""",
}
assert FLAG_NOTES.keys() >= {"truncated", "unreadable"}


def _needs(sql: str, seen: dict[str, None]) -> dict[str, None]:
    """The named parts that a statement refers to, each after those that it refers to itself."""
    import re

    for name in CTE:
        if name not in seen and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
            _needs(CTE[name], seen)
            seen[name] = None
    return seen


def statements() -> dict[str, str]:
    out = {}
    for name, body in BODY.items():
        parts = ",\n".join(f"{n} AS ({CTE[n]})" for n in _needs(body, {}))
        own = body.strip()
        if own.upper().startswith("WITH "):
            own, parts = own[5:], parts + ",\n" if parts else ""
            out[name] = f"WITH {parts}{own}"
        else:
            out[name] = f"WITH {parts}\n{own}" if parts else own
    return out
