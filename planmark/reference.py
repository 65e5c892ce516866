"""Fixed values. They must equal the documented ones for results to match."""

from __future__ import annotations

# ---- fixed values: units, in lookup order (length to mm, weight to kg) ----
LENGTH_TO_MM = {
    "mm": 1.0,
    "cm": 10.0,
    "m": 1000.0,
    "inch": 25.4,
    "in": 25.4,
    '"': 25.4,
    "ft": 304.8,
    "yard": 914.4,
}
WEIGHT_TO_KG = {
    "kg": 1.0,
    "g": 0.001,
    "mg": 0.000001,
    "lb": 0.453592,
    "lbs": 0.453592,
    "oz": 0.0283495,
    "ton": 1000.0,
}

# ---- fixed values: technical symbols ----
SYMBOL_WORDS = {
    "Ø": "diameter",
    "ø": "diameter",
    "⌀": "diameter",
    "±": "plus_minus",
    "°": "degrees",
    "′": "minutes",
    "″": "seconds",
    "□": "square",
    "∠": "angle",
    "⊥": "perpendicular",
    "∥": "parallel",
    "≈": "approximately",
    "≤": "less_than_or_equal",
    "≥": "greater_than_or_equal",
}

# ---- fixed values: manufacturer names ----
OEM_NAMES = [
    "SKF", "Timken", "NSK", "NTN", "FAG", "INA",
    "Schaeffler", "KOYO", "NACHI", "THK", "IKO",
]

# ---- fixed values: entity types ----
ENTITY_TYPES = [
    "PART_NUMBER", "OEM", "MATERIAL", "DIMENSION", "WEIGHT", "THREAD_SPEC", "TOLERANCE",
    "SURFACE_FINISH", "QUANTITY", "SCALE", "REVISION", "DATE", "DRAWING_NUMBER",
]

# ---- fixed values: extraction patterns and their confidences ----
PART_NUMBER_PATTERN = r"\b[A-Z]{2,10}[-_]?[A-Z0-9]{4,20}(?:[-_][A-Z0-9]+)?\b"
DIMENSION_PATTERN = (
    r"\b(?:Ø|ø|⌀)?\s*\d+\.?\d*\s*(?:[±]?\s*\d*\.?\d*)?\s*"
    r'(?:mm|cm|m|in|inch|")\b'
)
WEIGHT_PATTERN = r"(?i)\b\d+\.?\d*\s*(?:kg|g|lbs|oz)\b"
THREAD_PATTERN = r"\b(?:M\d+[xX]?\d*\.?\d*|#?\d+[-/]\d+\s*(?:UNC|UNF))\b"
MATERIAL_PATTERN = r"(?i)\b(?:steel|aluminum|brass|stainless|titanium|plastic)\s+[A-Z0-9\-]+\b"
FINISH_PATTERN = r"\b(?:Ra\s*\d+\.?\d*|N\d+)\b"
TOLERANCE_PATTERN = r"[±]\s*\d+\.?\d*\s*(?:mm|cm|m|in)?\b"
DIMENSION_VALUE_PATTERN = r'([Øø⌀])?\s*(\d+\.?\d*)\s*([±]?\s*\d+\.?\d*)?\s*([a-zA-Z"′″]+)?'
WEIGHT_VALUE_PATTERN = r"^(\d+\.?\d*)\s*([a-zA-Z]+)"
SCALE_PATTERN = r"(?:SCALE|Scale)[:\s]*(\d+:\d+|1:\d+)"
DATE_PATTERN = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
REVISION_PATTERN = r"(?:REV|Rev|Revision)[:\s]*([A-Z0-9]+)"

REGEX_LAYERS = {
    "PART_NUMBER": (PART_NUMBER_PATTERN, 0.90),
    "DIMENSION": (DIMENSION_PATTERN, 0.85),
    "WEIGHT": (WEIGHT_PATTERN, 0.85),
    "THREAD_SPEC": (THREAD_PATTERN, 0.90),
    "MATERIAL": (MATERIAL_PATTERN, 0.75),
    "SURFACE_FINISH": (FINISH_PATTERN, 0.80),
    "TOLERANCE": (TOLERANCE_PATTERN, 0.85),
}
DICTIONARY_CONFIDENCE = 0.85
MODEL_REPLY_CONFIDENCE = 0.9
CRITICAL_TYPES = ["PART_NUMBER", "OEM"]

# ---- fixed values: dimension wording and compatible shape classes ----
DIMENSION_WORDS = r"(?i)mm|cm|inch|in|\"|\bm\b|\br\b|ø|±|diameter|thread|tol"
TITLE_WORDS = (
    r"(?i)\b(note|rev|title|scale|sheet|date|drawn|checked|approved|qty|item)\b"
)
CYLINDER_CLASSES = ["shaft", "hole", "pin", "cylinder", "bearing", "bushing"]
THREADED_CLASSES = ["bolt", "screw", "nut", "washer", "threaded_hole", "stud"]
THREAD_HINTS = ["m6", "m8", "m10", "thread", "pitch"]
FASTENER_CLASSES = ["bolt", "screw", "nut", "washer", "pin", "fastener"]
LABELLED_CLASSES = ["bolt", "nut", "screw", "gear", "bearing"]

# ---- fixed values: validation ----
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SEVERITY_PENALTY = {"CRITICAL": 0.30, "HIGH": 0.15, "MEDIUM": 0.05, "LOW": 0.02}
MAX_PENALTY = 0.50

# ---- fixed values: scoring and routing ----
ROUTING_ENTITY_WEIGHTS = {
    "PART_NUMBER": 0.40,
    "OEM": 0.15,
    "MATERIAL": 0.10,
    "DIMENSION": 0.15,
    "WEIGHT": 0.05,
    "THREAD_SPEC": 0.05,
    "TOLERANCE": 0.05,
    "SURFACE_FINISH": 0.05,
}
ROUTING_SCORE_WEIGHTS = {
    "ocr_quality": 0.20,
    "entity_completeness": 0.35,
    "shape_detection_quality": 0.25,
    "critical_field_presence": 0.15,
    "data_consistency": 0.05,
}
COMPLETENESS_ENTITY_WEIGHTS = {
    "PART_NUMBER": 1.0,
    "DIMENSION": 0.8,
    "OEM": 0.5,
    "MATERIAL": 0.3,
    "WEIGHT": 0.2,
}
STAGE_COSTS = {"ocr_verification": 0.02, "entity_extraction": 0.08, "shape_validation": 0.04}
DIMENSION_TO_STAGE = {
    "critical_field_presence": "entity_extraction",
    "data_consistency": "shape_validation",
    "entity_completeness": "entity_extraction",
    "ocr_quality": "ocr_verification",
    "shape_detection_quality": "shape_validation",
}

# ---- fixed values: allowed stage order ----
STAGE_TRANSITIONS = {
    "pdf_processing": ["image_preprocessing"],
    "image_preprocessing": ["ocr_extraction"],
    "ocr_extraction": ["shape_detection"],
    "shape_detection": ["entity_extraction"],
    "entity_extraction": ["data_association", "llm_enhancement"],
    "data_association": ["validation", "llm_enhancement"],
    "llm_enhancement": ["validation"],
    "validation": ["complete"],
    "complete": [],
}

# ---- fixed values: model prices in USD per million tokens (input, output) ----
MODEL_PRICES = {
    "gpt-4o": (2.50, 10.00),
    "gpt-4-turbo-2024-04-09": (10.00, 30.00),
    "gpt-4-turbo": (10.00, 30.00),
    "gpt-4-vision-preview": (10.00, 30.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4": (30.00, 60.00),
    "gpt-3.5-turbo": (0.50, 1.50),
    "gemini-1.5-pro": (1.25, 5.00),
    "gemini-1.5-pro-latest": (1.25, 5.00),
    "gemini-1.5-flash": (0.075, 0.30),
    "gemini-1.5-flash-latest": (0.075, 0.30),
    "gemini-pro": (0.50, 1.50),
    "gemini-pro-vision": (0.50, 1.50),
}

# ---- fixed values: model per use case by tier (premium, balanced, cheap) ----
USE_CASE_MODELS = {
    "drawing_assessment": ("claude-3-haiku", "claude-3-haiku", "claude-3-haiku"),
    "ocr_verification": ("claude-3-sonnet", "claude-3-sonnet", "claude-3-haiku"),
    "entity_extraction": ("gpt-4-turbo", "gpt-4-turbo", "gpt-4o-mini"),
    "shape_validation": ("gpt-4o", "gpt-4o", "gpt-4o-mini"),
    "complex_reasoning": ("claude-3-opus", "claude-3.5-sonnet", "claude-3-haiku"),
}

# ---- fixed values: table rules ----
LOW_TEXT_CONFIDENCE = 0.85
LOW_ENTITY_CONFIDENCE = 0.80
LOW_SHAPE_CONFIDENCE = 0.45
DRAWING_STATUSES = ["processing", "complete", "failed", "review"]
PIPELINES = ["BASELINE", "HYBRID", "LLM_ENHANCED"]
OCR_ENGINES = ["paddleocr", "easyocr"]
REGION_TYPES = ["dimension", "label", "note", "title_block", "table", "text", "figure"]
EXTRACTION_METHODS = ["regex", "spacy", "llm", "llm_override"]
RELATIONSHIP_TYPES = ["dimension", "label", "note"]
PROVIDERS = ["openai", "anthropic", "google"]
USE_CASES = list(USE_CASE_MODELS)
AUDIT_STAGES = [
    "pdf_processing", "image_preprocessing", "ocr_extraction", "entity_extraction",
    "shape_detection", "data_association", "quality_scoring", "llm_enhancement", "export",
]
AUDIT_STATUSES = ["started", "completed", "failed", "skipped"]
SORT_COLUMNS = ["processing_timestamp", "overall_confidence", "drawing_id", "source_file"]
MAX_PAGE = 1000
CSV_FORMULA_PREFIXES = ["=", "+", "-", "@", "\t", "\r"]

# ---- fixed values: error wording ----
TRANSIENT_DB_WORDS = [
    "locked", "timeout", "connection", "busy", "temporary", "deadlock", "operational",
]
PERMANENT_DB_WORDS = [
    "integrity", "constraint", "foreign key", "unique", "not null", "check constraint",
]
TRANSIENT_API_WORDS = [
    "rate limit", "too many requests", "service unavailable", "gateway timeout", "bad gateway",
]
PERMANENT_CALL_WORDS = ["api key", "authentication", "401", "403", "invalid", "malformed"]
TRANSIENT_CALL_WORDS = [
    "rate limit", "timeout", "503", "502", "500", "connection", "temporary", "overloaded",
    "too many requests",
]
