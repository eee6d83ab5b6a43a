"""Tables of the engine."""

COLLECTIONS = "id long, name string, path string, glob string, context string"
DOCUMENTS = "id long, collection string, path string, title string, docid string, hash string, active boolean, doc_len long, content string"
VECTORS = "hash string, seq int, pos int, text string, vec array<float>"
OBSERVATIONS = "docid string, path string, hash string, note string, timestamp string"

GLOB = "**/*.md"
MAX_BYTES = 1 << 20
K1, B, TARGET_B = 1.2, 0.75, 0.55
FIELD_WEIGHTS = {"title": 5.0, "content": 1.0, "docid": 0.0}
FALLBACK_LENGTH = 500.0
RRF_K = 60
LIST_DEPTH, RERANKED = 20, 30
LIMIT, MIN_COSINE = 10, 0.3
