"""The data model: schemas of the canonical relations, limits, errors and result pages."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Row

OBJECTS = "oid binary, kind string, size long, data binary"
TREE_ENTRIES = "tree_oid binary, ordinal int, mode int, name binary, oid binary, kind string"
IDENTITY = "struct<name:binary,email:binary,time:bigint,tz:binary,tz_offset_minutes:int>"
COMMITS = f"oid binary, tree_oid binary, parents array<binary>, author {IDENTITY}, committer {IDENTITY}, subject binary, subject_truncated boolean, message_raw binary, message_truncated boolean, signature_headers array<binary>, encoding binary"
TAGS = f"oid binary, target_oid binary, target_kind string, name binary, tagger {IDENTITY}, message binary"
REFS = "name binary, kind string, oid binary, symbolic_target binary, peeled binary"
MANIFEST = "id string, pack_key string, index_key string, pack_size long, index_size long, etag string"
SUBMODULES = "name binary, path binary, url binary, branch binary, commit_oid binary, status string"

CODES = (
    "invalid_argument invalid_oid invalid_path invalid_cursor unsupported_hash unsupported_operation unsupported_regex not_a_commit not_a_tree not_a_blob "
    "ref_not_found ambiguous_prefix not_found missing_object shallow_boundary malformed_object malformed_bundle malformed_ref hash_mismatch "
    "pack_checksum_mismatch index_checksum_mismatch object_too_large budget_exceeded result_too_large timeout await_timeout cancelled busy conflict "
    "authentication_failed network_error cleanup_failed credentials_unavailable provider_down provider_timeout provider_protocol_error backend_error "
    "runtime_mismatch internal_error"
).split()
_RETRYABLE = frozenset({"timeout", "await_timeout", "busy", "network_error", "provider_down", "provider_timeout", "conflict"})


class EngineError(Exception):
    """An error with a stable code; arguments of a wrong type raise TypeError instead."""

    def __init__(self, code: str, message: str = "", **details: Any):
        if code not in CODES:
            raise ValueError(f"no such error code: {code}")
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message, self.details = code, message, details
        self.retryable = code in _RETRYABLE


@dataclass(frozen=True)
class Limits:
    """Ceilings of one query; all must be positive."""

    timeout_ms: int = 30_000
    max_objects: int = 100_000
    max_object_bytes: int = 4 << 20
    max_total_object_bytes: int = 256 << 20
    max_provider_requests: int = 500
    max_provider_bytes: int = 256 << 20
    max_tree_entries: int = 20_000
    max_results: int = 1_000
    max_diff_files: int = 1_000
    max_diff_hunks: int = 10_000
    max_diff_lines: int = 100_000
    max_result_bytes: int = 8 << 20
    max_delta_depth: int = 128

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"{f.name} must be an integer")
            if value < 1:
                raise EngineError("invalid_argument", f"{f.name} must be positive")


@dataclass
class Page:
    """A bounded part of a result, in the query's order; next_cursor continues it."""

    items: list[Row]
    next_cursor: str | None = None
    truncated: bool = False
    stats: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
