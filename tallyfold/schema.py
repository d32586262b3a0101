"""Schemas of the fact table, its side tables, and the JSON of one transcript line."""

from __future__ import annotations

USAGE = ["input_tokens", "output_tokens", "think_tokens", "cache_read", "cache_write5m", "cache_write1h"]

#: Columns that extraction derives from a line's body.
EXTRACTED = ["session_id", "line_uuid", "captured_at", "request_id", "model", *USAGE, "pr_repo", "pr_number", "cwd", "git_branch"]

RECORDS = (
    "origin_id string, seq long, source string, path string, byte_offset long, content_hash string, session_id string, line_uuid string, captured_at string, request_id string, model string, "
    "input_tokens long, output_tokens long, think_tokens long, cache_read long, cache_write5m long, cache_write1h long, pr_repo string, pr_number long, cwd string, git_branch string, sealed string, received_at string"
)
RECORD_COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]
BRONZE = "source string, path string, byte_offset long, content_hash string, value string"
PEERS = "peer_id string, addrs array<string>, last_seen timestamp, static boolean, last_converged timestamp, last_error string, last_vector map<string,long>, hostname string, version string"
HOSTNAMES = "ip string, hostname string, resolved_at timestamp"
QUARANTINE = "origin_id string, seq long, content_hash string, sealed string, noticed_at string"
EXTRACTION = "origin_id string, version int, seq long"
PRICES = "id string, input double, output double, cache_read double, cache_write_5m double, cache_write_1h double"

LINE = (
    "type string, sessionId string, uuid string, timestamp string, requestId string, cwd string, gitBranch string, prRepository string, prNumber bigint, "
    "message struct<model:string, usage:struct<input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, output_tokens_details:struct<thinking_tokens:bigint>, "
    "cache_creation:struct<ephemeral_5m_input_tokens:bigint, ephemeral_1h_input_tokens:bigint>>>, _corrupt string"
)
