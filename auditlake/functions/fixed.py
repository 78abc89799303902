"""Word lists, patterns and constants that results depend on."""

# fixed values ---------------------------------------------------------------

HEDGING = (
    r"vulnerability\s+suspected|suspected\s+vulnerability|suspected|maybe|may\s+be|might\s+be|could\s+be|appears\s+to|seems\s+to"
)

VULNERABILITY_CLASS = (
    r"overflow|underflow|out[-\s]?of[-\s]?bounds|oob|use[-\s]?after[-\s]?free|double[-\s]?free|null[-\s]?pointer|"
    r"division[-\s]?by[-\s]?zero|denial[-\s]?of[-\s]?service|dos|race|toctou|symlink|file[-\s]?write|injection|spoofing|"
    r"side[-\s]?channel|timing|leakage|leak|plaintext[-\s]?pattern|privilege[-\s]?escalation|memory\s+corruption|buffer|integer|"
    r"traversal|authentication|authorization|hash[-\s]?collision|collision|register\s+access|mdio|entropy|key[-\s]?material|environment\s+variable"
)

HYPHENS = "‐‑‒–—―−"

PREDICATE_STOPWORDS = [
    "the", "code", "is", "are", "to", "a", "an", "in", "of", "and", "or", "because", "when", "while", "via", "with", "without", "can", "may",
    "allow", "allows", "leading", "lead", "cause", "causes", "vulnerable", "vulnerability", "buffer", "overflow", "out", "bounds", "read", "write",
    "memory", "logic", "errors", "race", "condition", "null", "pointer", "dereference", "integer", "heap", "stack", "attack", "attacker", "denial",
    "service", "dos", "use", "after", "free", "privilege", "escalation",
]

CODE_STOPWORDS = [
    "the", "and", "for", "with", "this", "that", "from", "into", "code", "input", "output", "true", "false", "return", "public", "private",
    "class", "struct", "void", "int",
]

CODE_MARKERS = ["{", "}", ";", "#include", "def ", "class ", "return", "=>", "function ", "public ", "private ", "protected "]
CODE_KEYWORDS = (
    "if|else|for|while|return|class|struct|public|private|async|await|switch|case|try|catch|void|int|size_t"
)
CODE_OPERATORS = r"==|!=|<=|>=|->|=>|=|\+|-|\*|/"
CODE_PUNCTUATION = "{}();[]<>"

GENERIC_ANCHOR = [
    r"\bmissing\b",
    r"\bno\b.*\bvalidation\b",
    r"\bbounds\s*check(ing)?\b",
    r"\bmemory\s+safety\b",
    r"\blogic\s+error(s)?\b",
    r"\bvulnerab(le|ility)\b",
    r"\bunsafe\b",
    r"\bexploit\b",
    r"\battack(er)?\b",
]

GUARD_TERMS = ["guard", "invariant", "bounds check", "null check", "validation", "lock"]
MECHANISM_LABELS = ["source anchor:", "sink anchor:", "missing guard anchor:"]

CVE = r"[Cc][Vv][Ee]-[0-9]{4}-[0-9]{4,7}"
PREDICATE_PREFIX, CODE_DELIMITER = "Predicate: ", " | Code: "

HEURISTIC_POSITIVE = (
    "buffer overflow|integer overflow|use after free|out of bounds|memory corruption|race condition|denial of service|injection"
)
CODE_TOKEN = "def|class|function|if|return|void|int|char|struct|for|while|import|include|fn|const|curl"
MODEL_B_HIGH, MODEL_B_LOW, MODEL_C_ACCEPT = 0.995, 0.05, 0.65

TAXONOMY = {
    "memory_safety": [
        "buffer_overflow", "buffer overflow", "heap overflow", "stack overflow", "out_of_bounds", "out-of-bounds", "oob_write", "oob_read",
        "oob write", "use_after_free", "use-after-free", "double_free", "double free", "off_by_one", "off-by-one", "memcpy", "strcpy", "strncpy",
        "pointer", "null_deref", "null dereference", "dangling", "memory", "heap", "stack_buffer", "buffer",
    ],
    "integer_arithmetic": [
        "integer_overflow", "integer overflow", "int_overflow", "unsigned_wrap", "unsigned wrap", "wrap-around", "wraparound",
        "width_truncation", "truncation", "signedness", "integer_underflow", "integer underflow",
    ],
    "concurrency": [
        "toctou", "race_condition", "race condition", "deadlock", "double_checked_locking", "double-checked locking", "lock_free", "lock-free",
        "concurrent", "concurrency", "data_race", "data race", "thread_safety", "thread safety",
    ],
    "input_validation": [
        "command_injection", "command injection", "code_injection", "path_traversal", "path traversal", "directory_traversal", "format_string",
        "format string", "deserialization", "sql_injection", "sql injection", "xss", "cross_site", "injection", "untrusted", "input_validation",
    ],
}

SAFETY_KEYWORDS = [
    "free", "malloc", "memcpy", "memset", "sizeof", "null", "nullptr", "overflow", "use-after-free", "race condition", "out-of-bounds",
    "script inclusion", "leakage", "unsanitized", "disclosure", "privilege", "bypass", "pointer", "buffer", "integer", "format string",
    "injection", "dereference", "vulnerable", "bounds", "uaf", "double free", "type confusion",
]
CONTROL_KEYWORDS = ["if", "while", "for", "switch", "goto", "return", "struct", "typedef", "def", "class"]
SYMBOLS = ["*", "&", "->", "[", "]", "(", ")", ";", "=", "+", "-", "<", ">", "/"]

CQI_WEIGHTS = {"readability": 1.5, "maintainability": 1.5, "correctness": 2.0, "complexity": 1.0, "security": 2.0, "test_coverage": 1.0}
SCORE_PROPERTIES = ["understandable", "maintainable", "repeatable", "atomic", "necessary", "granular", "fast", "first_tdd"]
FAIL_DELTA, FAIL_PROPERTY, FAIL_SHARE, FAIL_DROPPED, DROP_POINTS = 0.25, 0.5, 0.05, 2, 2.0

BLOCKING_CATEGORIES = [
    "api compatibility", "boundary validation", "ci correctness", "compatibility", "correctness", "recoverability", "report contract",
    "schema contract", "security", "structured output", "telemetry", "validation",
]
BLOCKING_KEYWORDS = [
    "broken report", "broken schema", "ci result", "crash", "exception", "false ci", "false pass", "false fail", "injection",
    "malformed cassette", "missing validation", "path traversal", "schema", "unsafe", "unvalidated",
]

HIGH_WORDS = ["HIGH", "CERTAIN", "CRITICAL", "5", "4"]
MEDIUM_WORDS = ["MEDIUM", "MODERATE", "NORMAL", "3"]
LOW_WORDS = ["LOW", "WEAK", "POOR", "2", "1"]

VALID_SANITIZERS = {
    "MEMORY_WRITE": ["BOUNDS_CHECK", "RANGE_VALIDATION"],
    "ARRAY_INDEX": ["BOUNDS_CHECK", "RANGE_VALIDATION"],
    "POINTER_DEREF": ["NULL_CHECK"],
    "SYSTEM_CALL": ["COMMAND_SANITIZATION", "ALLOWLIST_CHECK"],
}
REQUIRED_SANITIZER = {
    "MEMORY_WRITE": "BOUNDS_CHECK", "ARRAY_INDEX": "RANGE_VALIDATION", "POINTER_DEREF": "NULL_CHECK", "SYSTEM_CALL": "COMMAND_SANITIZATION",
}
HIGH_RISK, LOW_RISK, RISK_LIMIT = 1.0, 0.05, 0.10

OUTCOME_SIGNS = {"VALID_ACCEPT": 1.0, "LOGIC_ERROR": -1.5, "DEAD_END_CHAIN": -1.5}
OTHER_OUTCOME_SIGN, HALF_LIFE_DAYS, CORROBORATION = -0.5, 30.0, 2

REPAIR_TEMPLATES = {
    "B_UNSUPPORTED_SYNTAX": "Ensure complete, valid C/C++ AST syntax with properly matched delimiters and clean variable declarations.",
    "B_LOGIC_ERROR": "Eliminate factual contradictions; rigorously ground all safety claims in verified source code semantics.",
    "B_ANCHOR_UNMATCHED": "Quote exact source line anchors verbatim from the target codebase (ensure non-generic syntax tokens).",
    "B_SOURCE_MISSING": "Trace explicit tainted data-flow propagation originating from untrusted input parameters.",
    "B_SINK_MISSING": "Identify and ground concrete security-sensitive sink operations (memory write, dereference, system call).",
    "B_SANITIZER_MISMATCH": "Apply valid sink-specific guard validation ({required_sanitizer}) rather than {found_sanitizer}.",
    "B_SANITIZER_TARGET_MISMATCH": "Ensure sanitizer guard protects sink target '{target_var}' instead of guarding '{guarded_target}'.",
    "B_EDGE_MISSING": "Ensure data-flow graph contains an active, unbroken edge between source and sink AST nodes.",
}
REPAIR_DEFAULT = "Verify data-flow reachability and eliminate unsanitized sink dereferences."
REPAIR_FILLERS = {
    "required_sanitizer": "strict bounds checking", "found_sanitizer": "missing guard", "target_var": "target operand", "guarded_target": "unrelated variable",
}

STRICT_REASONS = ["anchors_too_few_after_normalization", "anchors_no_match", "mechanism_evidence_failed"]
SUPPORT_LEVELS = ["supported", "unsupported", "inconclusive"]
PHASE_ORDER = {
    "start": 0, "generated_sample": 10, "debate_complete": 20, "judge_complete": 30, "strict_gates_complete": 40, "verifier_complete": 50,
    "accepted": 100, "failed": 100,
}
FORMAT_CONVERSION = r"(%%|%[-+ #0]*[0-9]*(?:\.[0-9]*)?[hlLzjt]*[diuoxXfFeEgGaAcspn])"
# end of fixed values --------------------------------------------------------

# fixed values: acceptance bounds ----------------------------------------------
ANCHOR_MATCH_MIN, STRICT_FAIL_MAX, PARSE_OK_MIN, TOKEN_REDUCTION_MIN, DUPLICATE_MAX = 0.80, 0.20, 0.95, 25.0, 0.20
PARSE_COVERAGE_MIN, SIGNATURE_COVERAGE_MIN, UPTAKE_MIN, TRIAGE_GAIN_MIN = 0.65, 0.55, 0.30, 0.15
VIABLE_SHARE, VIABLE_RATE, ADVISORY_PRECISION = 0.50, 10.0, 0.80
# end of fixed values ----------------------------------------------------------
