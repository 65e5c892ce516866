"""Table schemas. Identifiers are strings here; operators accept any key type."""

BBOX = "struct<x:int,y:int,width:int,height:int>"
NORMALIZED_BBOX = "struct<x_center:double,y_center:double,width:double,height:double>"
NORMALIZED_VALUE = (
    "struct<raw:string,value:double,unit:string,tolerance:double,"
    "is_diameter:boolean,value_mm:double,value_kg:double>"
)

TABLES = {
    "drawings": (
        "drawing_id string, source_file string, processing_timestamp timestamp, "
        "pipeline_version string, overall_confidence double, routing_ocr_quality double, "
        "routing_entity_completeness double, routing_shape_quality double, "
        "routing_critical_field_presence double, routing_data_consistency double, "
        "pipeline_used string, llm_stages_used array<string>, needs_review boolean, "
        "review_flags array<struct<flag_type:string,severity:string,reason:string>>, "
        "status string"
    ),
    "text_extractions": (
        f"text_id string, drawing_id string, block_no bigint, content string, bbox {BBOX}, "
        "confidence double, ocr_engine string, region_type string"
    ),
    "entities": (
        "entity_id string, drawing_id string, entity_type string, value string, "
        f"normalized_value {NORMALIZED_VALUE}, original_text string, confidence double, "
        f"extraction_method string, source_text_id string, bbox {BBOX}"
    ),
    "shape_detections": (
        f"detection_id string, drawing_id string, class_name string, confidence double, "
        f"bbox {BBOX}, bbox_normalized {NORMALIZED_BBOX}, model_version string"
    ),
    "text_shape_associations": (
        "association_id string, drawing_id string, text_id string, detection_id string, "
        "relationship_type string, confidence double, distance_pixels double"
    ),
    "llm_usage": (
        "usage_id string, drawing_id string, use_case string, provider string, model string, "
        "canonical_model_name string, model_tier int, tokens_input bigint, tokens_output bigint, "
        "image_count bigint, cost_usd double, timestamp timestamp, tier_stepped_down boolean"
    ),
    "processing_audit": (
        "audit_id string, drawing_id string, stage string, status string, "
        "duration_seconds double, error_message string, error_traceback string, "
        "timestamp timestamp, metadata map<string,string>"
    ),
    "validation_issues": (
        "issue_id string, drawing_id string, severity string, issue_type string, "
        "message string, entity_id string, detection_id string, text_id string, "
        "timestamp timestamp"
    ),
    "assembly_edges": (
        "drawing_id string, parent_id string, child_id string, relationship string, "
        "confidence double"
    ),
}
