"""Schemas of landed payloads, discovered fields and the catalog tables."""

from __future__ import annotations

# One response or file as it arrived; `body` is the untouched text.
LANDED = "source_id string, dialect string, entity_hint string, path string, status int, body string"

# What every discovery operator returns: one row per field, and one row with a null
# position for an entity that has no field.
DISCOVERED = (
    "source_id string, path string, entity_no int, entity string, entity_type string, "
    "entity_description string, position int, name string, type string, native_type string, "
    "nullable boolean, primary_key boolean, foreign_key boolean, description string"
)
DISCOVERED_COLUMNS = [c.split()[0] for c in DISCOVERED.split(", ")]

SOURCES = (
    "id string, name string, description string, category string, connector_type string, status string, "
    "host string, port int, database_name string, schema_name string, base_url string, auth_type string, "
    "username string, options string, tags array<string>, entity_count int, test_latency_ms int, "
    "error_message string, last_tested_at timestamp, last_synced_at timestamp, created_at timestamp, "
    "updated_at timestamp"
)
CONNECTION_TESTS = (
    "id string, source_id string, success boolean, latency_ms int, message string, tested_at timestamp"
)
ENTITIES = (
    "id string, source_id string, name string, display_name string, entity_type string, description string, "
    "row_count bigint, is_visible boolean, created_at timestamp"
)
FIELDS = (
    "id string, entity_id string, source_id string, name string, display_name string, data_type string, "
    "native_type string, is_nullable boolean, is_primary_key boolean, is_foreign_key boolean, position int"
)
RELATIONS = (
    "id string, source_id string, source_entity_id string, target_entity_id string, source_field string, "
    "target_field string, relation_type string, confidence double, is_confirmed boolean"
)

# Length limits the catalog checks: column -> longest text.
MAX_LENGTHS = {
    "entities": {"name": 255, "display_name": 255, "entity_type": 50},
    "fields": {"name": 255, "display_name": 255, "data_type": 50, "native_type": 100},
}

# ---- fixed values: connector type -> category ----
CONNECTOR_CATEGORIES = {
    "database": ["postgresql", "mysql", "mssql", "sqlite", "sap_hana", "sage_100"],
    "webservice": [
        "rest", "odata", "graphql", "soap", "sap_rfc", "sap_odata", "dynamics365", "sage_x3", "sage_cloud",
    ],
    "file": ["file_csv", "file_excel", "file_json"],
}
AUTH_TYPES = ["none", "basic", "bearer", "oauth2", "api_key", "windows_auth"]
STATUSES = ["pending", "active", "error", "disabled"]
