"""Row types of the engine."""

from __future__ import annotations

BUCKETS = ("projects", "tokens", "chains", "topics", "people")

RAW_ITEM = (
    "id string, title string, translated_title string, content string, translated_content string, full_content string, "
    "translated_full_content string, publish_time string, source_url string, page_url string, jump_url string, source_name string, "
    "source_title string, nickname string, username string, source_lang string, language string, "
    "tags array<struct<type:string,name:string,symbol:string>>"
)
EMBEDDING = "item_id string, item_hash string, model string, published_at timestamp, title string, source_name string, embedding array<float>, seq long"
MENTION = "batch_id long, ord long, category string, canonical_name string, aliases array<string>, evidence_title string, evidence_source string"
DECISION = (
    "source_id string, action string, final_category string, final_canonical_name string, final_aliases array<string>, reason string"
)
DISCOVERY_RUN = (
    "run_id long, created_at timestamp, model string, latest_limit long, trending_limit long, batch_size long, min_mentions long, "
    "min_docs long, doc_count long, candidate_count long"
)
DISCOVERY_CANDIDATE = (
    "run_id long, category string, canonical_name string, mention_count long, doc_count long, aliases array<string>, "
    "evidence_titles array<string>, source_names array<string>"
)
PROMOTED = (
    "category string, canonical_name string, status string, run_hits long, total_mentions long, max_doc_count long, source_diversity long, "
    "decayed_run_score double, aliases array<string>, evidence_titles array<string>, source_names array<string>, last_seen_run_id long, "
    "last_qualified_run_id long, last_evaluated_run_id long, stale_cycles long, cooling_started_at timestamp, archived_at timestamp, "
    "promoted_at timestamp"
)
PROFILE = (
    "user_id string, interests array<string>, muted_topics array<string>, preferred_languages array<string>, "
    "followed_projects array<string>, followed_kols array<string>, risk_preference string"
)
