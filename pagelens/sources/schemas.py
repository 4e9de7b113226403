"""Schemas of the asset tables, as Spark types; ids are 64-bit, times are timestamps, JSON stays text."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

_TYPES = {"id": LongType(), "text": StringType(), "int": IntegerType(), "short": ShortType(), "flag": BooleanType(), "time": TimestampType(), "score": DecimalType(5, 2), "date": DateType()}


def _table(columns: str) -> StructType:
    """``name:type`` for columns that always have a value, ``name:type?`` for others."""
    fields = [c.split(":") for c in columns.split()]
    return StructType([StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")) for name, kind in fields])


# Names, kinds and nullability of the columns.
SITES = _table("""site_id:id domain:text site_root_url:text scope_root_url:text scope_key:text business_type:text? total_url_count:int snapshot_url_count:int
 discovery_json:text? key_pages_json:text? last_discovered_at:time? last_snapshot_at:time? created_at:time updated_at:time""")
URLS = _table("""url_id:id site_id:id normalized_url:text url_hash:text final_url:text? url_type:text discovery_source:text priority:short fetch_status:text is_active:flag
 last_discovered_at:time? last_fetched_at:time? created_at:time updated_at:time""")
PAGE_SNAPSHOTS = _table("""snapshot_id:id site_id:id url_id:id normalized_url:text final_url:text url_type:text fetch_status:text status_code:int? title:text? meta_description:text? canonical:text? lang:text?
 word_count:int html_length:int text_excerpt:text? content_hash:text? page_profile_json:text parsed_json:text? text_content:text? raw_html:text? fetched_at:time updated_at:time""")
GRAPH_ENTITIES = _table("""entity_id:id site_id:id entity_key:text entity_type:text canonical_name:text? canonical_url:text? source_snapshot_id:id? confidence:score attributes_json:text? created_at:time updated_at:time""")
GRAPH_EDGES = _table("""edge_id:id site_id:id edge_key:text from_entity_id:id to_entity_id:id relation_type:text confidence:score evidence_count:int attributes_json:text? first_seen_at:time? last_seen_at:time? created_at:time updated_at:time""")
GRAPH_EVIDENCE = _table("""evidence_id:id site_id:id entity_id:id? edge_id:id? snapshot_id:id? url_id:id? evidence_type:text evidence_field:text? selector_or_path:text? evidence_text:text? confidence:score created_at:time""")
GRAPH_SNAPSHOTS = _table("""graph_snapshot_id:id site_id:id task_id:text? graph_version:text source_snapshot_count:int entity_count:int edge_count:int evidence_count:int graph_json:text? note:text? built_at:time created_at:time""")
AUDIT_TASKS = _table("""task_id:text site_id:id? domain:text task_type:text mode:text status:text cache_key:text? url:text normalized_url:text feedback_lang:text force_refresh:flag cached:flag full_audit:flag requested_max_pages:int
 result_json:text? error_text:text? created_at:time updated_at:time completed_at:time?""")

TABLES = {"sites": SITES, "urls": URLS, "page_snapshots": PAGE_SNAPSHOTS, "graph_entities": GRAPH_ENTITIES, "graph_edges": GRAPH_EDGES, "graph_evidence": GRAPH_EVIDENCE, "graph_snapshots": GRAPH_SNAPSHOTS, "audit_tasks": AUDIT_TASKS}
