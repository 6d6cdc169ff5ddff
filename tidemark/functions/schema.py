"""Schemas of the store's tables, all Parquet and append-only. Newer versions are refused."""

from __future__ import annotations

VERSION = 1

VALUE = "kind STRING, blob BINARY, counter BIGINT, members ARRAY<STRING>, flag BOOLEAN, body STRING, number DOUBLE"
CLAIM = "predicate STRING, subject STRING, valid_start BIGINT, valid_end BIGINT, known_start BIGINT, known_end BIGINT, confidence DOUBLE, method STRING, calibration STRING, evidence ARRAY<STRING>, status STRING, actor STRING"
OBSERVATION = "source STRING, trust TINYINT, observed_at BIGINT, ingested_at BIGINT, payload STRING"
#: What a writer hands over: exactly one of observation, claim and value is not null.
WRITE = f"key STRING, observation STRUCT<{OBSERVATION}>, claim STRUCT<{CLAIM}>, value STRUCT<{VALUE}>"

RECORDS = f"commit_id STRING, branch STRING, seq BIGINT, key STRING, op STRING, observation STRUCT<{OBSERVATION}>, claim STRUCT<{CLAIM}>, value STRUCT<{VALUE}>"
DERIVATIONS = "commit_id STRING, branch STRING, seq BIGINT, key STRING, node_id STRING, actor STRING, parents ARRAY<STRING>, sources ARRAY<STRING>"
CLAIM_VERSIONS = f"commit_id STRING, branch STRING, seq BIGINT, claim STRUCT<{CLAIM}>"
INDEX_ENTRIES = "commit_id STRING, branch STRING, seq BIGINT, key STRING, op STRING, text STRING, embedding ARRAY<FLOAT>, citations ARRAY<STRING>, stale BOOLEAN, label INT"

TABLES = {"records": RECORDS, "derivations": DERIVATIONS, "claim_versions": CLAIM_VERSIONS, "index_entries": INDEX_ENTRIES}
