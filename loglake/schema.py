"""Types of the tables: raw records, extracted fields, normalised events, dead letters."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import types as T

SCHEMA_VERSION = "1.2.0"
VALUE = "struct<v:string,t:string>"
FIELDS = f"map<string,{VALUE}>"
_CONTEXT = "struct<ip:string,ip_type:string,is_internal:boolean,is_public:boolean,is_threat:boolean,threat_intel:array<string>,cloud_provider:string,cloud_service:string>"

RAW = "tenant_id string, source_tag string, seq bigint, raw_bytes binary, line string, ingest_ts timestamp"

EVENT_DDL = f"""
    schema_version string, tenant_id string, event_id string, ingest_timestamp string, source_event_timestamp string,
    raw struct<raw_payload:string,raw_format:string,raw_hash:string>,
    source struct<vendor:string,product:string,device_hostname:string,source_ip:string,log_format:string>,
    event struct<category:string,class_name:string,class_uid:int,activity_name:string,activity_id:int,action:string,outcome:string,severity_numeric:double,severity_original:string,severity_inferred:boolean,event_type_vendor_specific:string>,
    network struct<src_ip:string,src_port:bigint,dst_ip:string,dst_port:bigint,protocol:string,bytes_in:bigint,bytes_out:bigint,direction:string,interface:string>,
    identity struct<username:string,user_domain:string>,
    rule struct<rule_id:string,rule_name:string,policy_action:string>,
    vendor_attributes {FIELDS},
    enrichment struct<src_ip_context:{_CONTEXT},dst_ip_context:{_CONTEXT},threat_ip_detected:boolean,threat_intel_tags:array<string>>,
    analytics struct<anomaly_score:double,anomaly_reasons:array<string>,is_anomalous:boolean,risk_score:double>,
    lineage struct<parser_name:string,parser_version:string,normalization_ruleset_version:string>
"""

DEAD_LETTER_DDL = """
    schema_version string, tenant_id string, event_id string, ingest_timestamp string, raw_payload string, raw_hash string,
    raw_format string, stage string, error_type string, error_message string, validation_errors array<string>,
    source_tag string, parser string, failed_sink string, timestamp string
"""


@lru_cache
def event_schema() -> T.StructType:
    """Needs a session: Spark parses the types."""
    return T.StructType.fromDDL(EVENT_DDL)


@lru_cache
def dead_letter_schema() -> T.StructType:
    return T.StructType.fromDDL(DEAD_LETTER_DDL)


# The closed sets of the event schema.
CATEGORIES = ["network", "authentication", "threat", "system", "policy", "api", "database", "unknown"]
OUTCOMES = ["success", "failure", "unknown"]
DIRECTIONS = ["inbound", "outbound", "internal", "unknown"]
