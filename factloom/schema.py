"""Table schemas and enumerations; nothing is ever inferred."""

from __future__ import annotations

TRIPLE_TYPES = ("ENTITY_ENTITY", "ENTITY_EVENT", "EVENT_EVENT", "EMOTIONAL_CONTEXT")
ABSTRACTION_LEVELS = ("HIGH", "MEDIUM", "LOW")
CODEC = "zstd"  # of written files, which take about two thirds of what they do by the default
JOB_STATUSES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED")
JOB_STAGES = ("EXTRACTION", "CONCEPTS", "DEDUPLICATION")
VECTOR_TYPES = ("ENTITY", "RELATIONSHIP", "SEMANTIC", "CONCEPT")
TRIPLE_KEY = ["subject", "predicate", "object", "type"]

TRIPLES = (
    "id string, subject string, predicate string, object string, type string, source string, source_type string, "
    "source_date timestamp, extracted_at timestamp, confidence decimal(3,2)"
)
CONCEPTS = "id string, concept string, abstraction_level string, confidence decimal(3,2), source string, source_type string, extracted_at timestamp"
CONCEPTUALIZATIONS = (
    "id string, source_element string, triple_type string, concept string, confidence decimal(3,2), context_triples array<string>, "
    "source string, source_type string, extracted_at timestamp"
)
VECTORS = "vector_id string, text string, embedding array<float>, vector_type string, entity_name string, knowledge_triple_id string, concept_node_id string"
DICTIONARY = "digest string, model string, text string, embedding array<float>"
TOKEN_USAGE = (
    "id string, source string, source_type string, operation_type string, provider string, model string, input_tokens int, output_tokens int, "
    "total_tokens int, thinking_tokens int, reasoning_tokens int, duration_ms int, estimated_cost decimal(10,6), timestamp timestamp"
)
JOBS = (
    "id string, job_type string, parent_job_id string, stage string, text string, metadata string, status string, progress int, result string, "
    "error_message string, created_at timestamp, started_at timestamp, completed_at timestamp, retry_count int, max_retries int, metrics string"
)
