"""DuckDB SQL equivalent to the queries of this subpackage that SQL can express."""

from textlathe.functions.release_sql import CLAIMS
from textlathe.llm.split import WHITE

_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]+"


def _over(name: str, key: str, col: str, limit: int) -> str:
    return f"""SELECT '{name}' AS item_table, CAST({key} AS VARCHAR) AS item_key, '{col}' AS field,
  CAST(list_max(list_transform(regexp_split_to_array({col}, '{_WS}'), lambda x: length(x))) > {limit} AS INTEGER) AS unbroken
FROM {name} WHERE length({col}) > {limit}"""


ORACLES = {
    "p3_found": " UNION ALL ".join([_over("chunk", "chunk_id", "text", 1200), _over("chunk", "chunk_id", "heading", 120), _over("search_record", "seq", "fragment_text", 1200)]),
    "p4_found": f"""WITH {CLAIMS},
  groups AS (SELECT release, min(record_id) AS group_id FROM keyed WHERE release IS NOT NULL GROUP BY release HAVING count(*) > 1),
  ranks AS (SELECT lower(trim(source)) AS src, min(trust_rank) AS rank FROM metric_source GROUP BY 1),
  ordered AS (
    SELECT release, field, record_id, row_number() OVER (PARTITION BY release, field
      ORDER BY coalesce(rank, 1000000000), captured_at DESC NULLS LAST, record_id DESC) AS n
    FROM claims LEFT JOIN ranks USING (src) WHERE value IS NOT NULL)
SELECT group_id, field, record_id FROM ordered JOIN groups USING (release) WHERE n = 1""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
