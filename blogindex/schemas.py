"""Record layouts, stated once and passed to every reader."""

from __future__ import annotations

FRONTIER = "location STRING, retries INT"

FETCHED = "url STRING, content_type STRING, html STRING"

FETCH_STATUS = "url STRING, ok BOOLEAN, error STRING"

PAGE = (
    "title STRING, description STRING, author STRING, "
    "keywords ARRAY<STRING>, headings ARRAY<STRING>, content ARRAY<STRING>, "
    "links ARRAY<STRING>, script_links ARRAY<STRING>, script_content ARRAY<STRING>, "
    "location STRING, created_at BIGINT"
)

# Columns of a crawled page in declaration order.
PAGE_COLUMNS = [
    "title", "description", "author", "keywords", "headings", "content",
    "links", "script_links", "script_content", "location", "created_at",
]
TEXT_COLUMNS = ["title", "description", "author"]
LIST_COLUMNS = ["keywords", "headings", "content", "links", "script_links", "script_content"]

# Field sets of the classifier: training reads fewer fields than serving.
TRAIN_FIELDS = ["title", "description", "keywords", "headings", "content"]
SERVE_FIELDS = PAGE_COLUMNS[:-1]

# Columns a stored page carries, besides its timestamps.
STORED_COLUMNS = [
    "id", "url", "url_hash", "title", "description", "author", "headings", "content",
    "keywords", "links", "script_links", "domain", "content_hash", "word_count", "created_at",
]

STATS_COUNTERS = {
    "pages_processed": "processed",
    "pages_inserted": "inserted",
    "pages_updated": "updated",
    "pages_skipped": "skipped",
    "processing_errors": "errors",
}
