"""Column types of the tables, and the fixed value domains."""

from __future__ import annotations

# fixed values: event types, sources and methods accepted by validation
EVENT_TYPES = ("page_view", "interaction", "http_request", "login_success", "login_failure", "session_created",
               "session_terminated", "api_access", "sensitive_endpoint_access", "app_error", "waf_alert", "security_decision")
SOURCES = ("sdk", "auth", "api", "waf", "app")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")

EVENT_IN = ("event_type STRING, source STRING, timestamp STRING, session_id STRING, user_id STRING, source_ip STRING, "
            "user_agent STRING, method STRING, endpoint STRING, status_code INT, attributes STRING, is_synthetic BOOLEAN")

FEATURES = ("STRUCT<v INT, path STRING, path_depth INT, has_query BOOLEAN, query_length INT, param_count INT, "
            "special_char_count INT, is_request_event BOOLEAN, is_auth_event BOOLEAN, is_auth_endpoint BOOLEAN, "
            "is_sensitive_endpoint BOOLEAN, status_class STRING, is_error_status BOOLEAN, ua_class STRING, hour_utc INT, "
            "webdriver BOOLEAN, interaction_total BIGINT, page_seq BIGINT, load_ms BIGINT>")

FINDINGS = ("finding_id STRING, website_id STRING, agent_name STRING, rule_id STRING, title STRING, finding_type STRING, "
            "category STRING, technique_id STRING, event_id STRING, subject STRING, confidence DOUBLE, "
            "observed MAP<STRING,STRING>, derived MAP<STRING,DOUBLE>, thresholds MAP<STRING,DOUBLE>, "
            "event_ids ARRAY<STRING>, cited_events BIGINT, event_ids_truncated BOOLEAN")

LINKS = ("website_id STRING, cluster_id STRING, event_id STRING, related_event_id STRING, relationship_type STRING, "
         "strength DOUBLE")
