"""A code corpus derived from `documents` by one SQL expression that Spark and other engines read alike."""

from __future__ import annotations

NL = "chr(10)"
FENCE = "chr(96) || chr(96) || chr(96)"
QUOTES = "chr(34) || chr(34) || chr(34)"
#: The whole text of a row, as it is and as it stands between quotes in source code.
TEXT = "coalesce(text, '')"
ESCAPED = f"replace(replace({TEXT}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
#: A string literal of the whole text; on one line in the files that do not parse and are cut by indent.
LITERAL = f"""{QUOTES} || CASE doc_id % 13 WHEN 1 THEN replace(replace({ESCAPED}, chr(13), chr(92) || 'r'), {NL}, chr(92) || 'n') ELSE {ESCAPED} || {NL} END || {QUOTES}"""

#: id and content: a function with the row's whole text in a string, and what may stand before it. The choices come from doc_id alone.
CODE = f"""
SELECT doc_id AS id,
  CASE doc_id % 5 WHEN 0 THEN 'import os' || {NL} WHEN 1 THEN 'import math' || {NL} WHEN 2 THEN 'from sys.path import x' || {NL}
    WHEN 3 THEN 'import json, os' || {NL} ELSE '' END
  || CASE doc_id % 9 WHEN 8 THEN 'async ' ELSE '' END || 'def f' || CAST(doc_id AS STRING)
  || CASE doc_id % 7 WHEN 0 THEN '():' WHEN 1 THEN '(self):' WHEN 2 THEN '(x):' WHEN 3 THEN '(x, y=2):' WHEN 4 THEN '(x: int) -> int:'
    WHEN 5 THEN '( cls ):' ELSE '(' || {NL} || '    x, y):' END || {NL}
  || CASE doc_id % 4 WHEN 0 THEN '    ' || {LITERAL} || {NL}
    WHEN 1 THEN '    ' || chr(39) || chr(39) || chr(39) || 'Says f.' || chr(39) || chr(39) || chr(39) || {NL}
    WHEN 2 THEN '    ' || chr(39) || 'short' || chr(39) || {NL} ELSE '' END
  || CASE WHEN doc_id % 4 > 0 THEN '    s = ' || {LITERAL} || {NL} ELSE '' END
  || CASE doc_id % 6 WHEN 0 THEN '    # TODO later' || {NL} WHEN 1 THEN '    # Todo later' || {NL} WHEN 2 THEN '    # denote it' || {NL} ELSE '' END
  || CASE WHEN doc_id % 3 > 0 THEN '    if 1 and 2 and 3:' || {NL} || '        pass' || {NL} ELSE '' END
  || CASE WHEN doc_id % 3 > 1 THEN '    for i in []:' || {NL} || '        pass' || {NL} ELSE '' END
  || CASE doc_id % 2 WHEN 0 THEN '    return 1' ELSE '    pass' END || {NL}
  || CASE doc_id % 13 WHEN 0 THEN '1/0' || {NL} WHEN 1 THEN 'def (:' || {NL} ELSE '' END AS content
FROM documents"""

#: id, prompt and output: completions of every kind, each with the row's whole text.
COMPLETIONS = f"""
SELECT doc_id AS id, 'Q: ' || {TEXT} AS prompt,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Q: ' || {TEXT} ELSE 'no ' END || {NL} || ' '
  || CASE doc_id % 7 WHEN 0 THEN 'see ' || {FENCE} || 'python' || {NL} || {TEXT} || {NL} || {FENCE} || ' done'
    WHEN 1 THEN {FENCE} || 'py' || {NL} || {TEXT} || {FENCE} WHEN 2 THEN {FENCE} || {FENCE} || ' then ' || {FENCE} || {TEXT} || {FENCE}
    WHEN 3 THEN {TEXT} || chr(92) || 'nInstruction: x' WHEN 4 THEN {TEXT} || {NL} || 'Instruction: x'
    WHEN 5 THEN '<response> ' || {TEXT} || ' </response> end' ELSE {TEXT} END
  || CASE doc_id % 2 WHEN 0 THEN chr(160) || ' ' || {NL} ELSE '' END AS output
FROM documents"""
