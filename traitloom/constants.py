"""Fixed values that must be the same for every reader of the data.

Everything in this file is a literal of the data format (sentinels, key names,
word lists, status codes, limits).  No logic lives here.
"""

# Answer vocabulary.
SENTINEL = "not_assessable"
NOMINAL, ORDINAL, QUANTITATIVE = "nominal", "ordinal", "quantitative"
CUSTOM_ID_SEPARATOR = "__"

# Record layout.
PROVENANCE_KEY = "_provenance"
IDENTITY_FIELDS = ("provider", "model", "schema_version")
RESERVED_COLUMNS = ("cultivar_id", "provider", "model", "schema_version")
STAMP_FIELDS = (
    "provider", "model", "schema_name", "schema_version",
    "tool_version", "created", "run_id",
)
RUN_STAMP_FILE = ".run.json"
GAP_SUFFIX = ".gaps.json"

# Image suffixes and their media types.
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png"}

# Statuses of one scored request.
STATUS_OK = "ok"
STATUS_CACHED = "skip (cached)"
STATUS_PARSE = "parse error"
STATUS_API = "api error"
STATUS_LENGTH = "length"
STATUS_LEAK = "reasoning leak"

# HTTP statuses worth a retry, and the one extra code of a provider.
TRANSIENT_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
OVERLOADED_STATUS = 529

# Phrases that mark a size-limit rejection (matched in lower case).
SIZE_LIMIT_MARKERS = ("exceeds limit of", "too complex", "too large", "too many")

# Constructs a constrained-output schema must not hold.
FORBIDDEN_KEYS = (
    "anyOf", "oneOf", "allOf", "not",
    "minLength", "maxLength", "minItems", "maxItems",
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "pattern", "$ref", "$defs", "definitions",
)

# Population and frequency wording, one pattern per phrase family.
POPULATION_PATTERNS = (
    r"\bnear-?universal\b",
    r"\boverwhelming(?:ly)?\b",
    r"\bmajority\b",
    r"\bminority\b",
    r"\bmost(?:ly)?\b",
    r"\brare\b",
    r"\buncommon\b",
    r"\bfrequen\w*",
    r"\bprevalen\w*",
    r"\bcultivars?\b",
    r"\bsupport(?:\s+count|\s*(?:[:=]\s*)?\d+)",
    r"\d+\s+of\s+(?:the\s+)?(?:described|cases|specimens|plants)",
    r"\bin\s+this\s+(?:material|dataset)",
    r"\bdo(?:es)?\s+not\s+occur",
    r"\bnot\s+seen",
)

# Words that read as absence in a first ordinal level, and the
# nominal categories that mean the same.
ABSENCE_PATTERN = r"\b(absent|absence|none|not present|lacking)\b"
ABSENCE_CATEGORIES = ("absent", "none", "absent/none")

# Schema hygiene limits.
MAX_NOMINAL_CATEGORIES = 7
MAX_ORDINAL_LEVELS = 7
ORDINAL_LEVELS_WITHOUT_NOTE = 5
SNAKE_CASE_PATTERN = r"^[a-z][a-z0-9]*+(?:_[a-z0-9]++)*+$"

# Request file guard and limit in bytes; batch discount; cache warning.
REQUEST_FILE_LIMIT = 200 * 1024 * 1024
REQUEST_FILE_GUARD = 190 * 1024 * 1024
BATCH_DISCOUNT = 0.5
WARM_HIT_WARN_PCT = 50.0
FAILURE_RUN_LENGTH = 3

# Columns of the two metric sample files.
SERVER_METRICS = (
    "num_requests_running", "num_requests_waiting", "num_preemptions_total",
    "prefix_cache_queries_total", "prefix_cache_hits_total",
    "mm_cache_queries_total", "mm_cache_hits_total", "kv_cache_usage_perc",
)
MEMORY_METRICS = ("mem_available_kb", "committed_as_kb")

#: Fixed value: what stands in a grouped text for a line without an answer.
NOT_FOUND_TEXT = "[NOT FOUND IN RESULTS]"
