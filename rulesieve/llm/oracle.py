"""SQL with the same rows as this subpackage's queries, where SQL can say it."""

from __future__ import annotations

_SAID = """(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t(conv_id, turn, role, text))"""
_MARKS = "len(regexp_extract_all({0}, '[<\\[]\\\\*(\\|[a-z_]+\\|>|/?s>|/?INST\\]|</?SYS>>)'))"
_ORDER = "ORDER BY turn, role, text"

ORACLES = {
    "op2_chat_format": f"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(length(role) + length(text) + {_MARKS.format('role')} + {_MARKS.format('text')} + 23)::BIGINT AS formatted_chars FROM {_SAID} GROUP BY conv_id""",
}
