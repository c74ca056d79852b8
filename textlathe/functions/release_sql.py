"""The release and value rules of `releases` as DuckDB SQL, for oracles."""

SEPARATORS = r"[\s\p{Z}_:/\\|,\x{ad}\x{200b}\x{2010}-\x{2015}\x{2212}\x{fe58}\x{fe63}\x{ff0d}-]+"


def clean(col: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({col}), '\s*\([^()]*\)[\s\p{{Z}}]*$', ''), '{SEPARATORS}', ' ', 'g'))"


NAME = r"^(?:.* )?(\p{L}+) ?v?(\d+(?:\.\d+)*) (\d+(?:\.\d+)?) ?([kmbt])(?: (\p{L}+))?$"
KEY = rf"""CASE WHEN regexp_matches({clean("model")}, '{NAME}')
  THEN concat_ws('|', regexp_extract({clean("model")}, '{NAME}', 1), regexp_extract({clean("model")}, '{NAME}', 2),
       regexp_replace(regexp_extract({clean("model")}, '{NAME}', 3), '\.0+$', '') || regexp_extract({clean("model")}, '{NAME}', 4), regexp_extract({clean("model")}, '{NAME}', 5))
  WHEN starts_with({clean("model")}, {clean("creator")} || ' ') THEN nullif(substr({clean("model")}, length({clean("creator")}) + 2), '')
  ELSE nullif({clean("model")}, '') END"""
STATED = r"^[~≈<>=]*\s*((?:\d{1,3}(?:[,_]\d{3})+|\d+)(?:\.\d+)?)\s*(k|m|b|t)?\s*(?:\([^()]*\))?$"
BARE = 'trim(lower("totalParams"))'
PARAMS = rf"""nullif(coalesce(TRY_CAST(replace(regexp_extract({BARE}, '{STATED}', 1), ',', '') AS DOUBLE), 0)
  * CASE regexp_extract({BARE}, '{STATED}', 2) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 't' THEN 1e12 ELSE 1 END, 0)"""
CLAIMS = f"""
  keyed AS (SELECT *, {KEY} AS release FROM param_estimation),
  claims AS (
    SELECT record_id, release, lower(trim(source)) AS src, captured_at, 'totalParams' AS field, {PARAMS} AS value FROM keyed
    UNION ALL SELECT record_id, release, lower(trim(source)), captured_at, 'mmlu_pro', CASE WHEN mmlu_pro > 0 AND NOT isnan(mmlu_pro) THEN mmlu_pro END FROM keyed
    UNION ALL SELECT record_id, release, lower(trim(source)), captured_at, 'intelligenceIndex', CASE WHEN "intelligenceIndex" > 0 AND NOT isnan("intelligenceIndex") THEN "intelligenceIndex" END FROM keyed
  )"""
