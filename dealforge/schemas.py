"""Schemas of the domain tables and of the landed inputs."""

from __future__ import annotations

SOURCES = "id string, name string, url string, source_type string, active boolean, last_fetched_at timestamp, created_at timestamp"
ARTICLES = "id string, source_id string, url string, title string, published_at timestamp, scraped_at timestamp, raw_text string, s3_key string, extraction_done boolean, extraction_error string, created_at timestamp"
DEALS = (
    "id string, article_id string, acquiring_entity string, seller_entity string, operator_names array<string>, facility_names array<string>, states array<string>, "
    "facility_count int, deal_value_m decimal(12,2), acquisition_date date, financing_amount_m decimal(12,2), lender string, stage string, confidence string, dedup_hash string, "
    "recheck_after date, recheck_count int, extraction_model string, created_at timestamp, updated_at timestamp"
)
FACILITIES = (
    "id string, ccn string, provider_name string, provider_state string, provider_city string, provider_zip string, ownership_type string, provider_type string, bed_count int, "
    "five_star_rating int, staffing_rating int, health_insp_rating int, sff_flag boolean, sff_candidate_flag boolean, cms_refreshed_at timestamp, created_at timestamp, updated_at timestamp"
)
OWNERS = (
    "id string, ccn string, provider_name string, owner_name string, owner_type string, owner_role string, ownership_percentage decimal(5,2), provider_state string, "
    "ownership_start_date date, cms_refreshed_at timestamp, created_at timestamp"
)
MATCHES = (
    "id string, deal_id string, ccn string, provider_name string, owner_name string, owner_type string, provider_state string, ownership_start_date date, match_score int, "
    "match_method string, matched_on_field string, verified boolean, created_at timestamp"
)
ANNOTATIONS = "id string, deal_id string, note string, tag string, created_at timestamp"
ALERT_LOG = "id string, deal_id string, alert_type string, sent_at timestamp"

#: Landed search hits of filings, one response a row.
FILING_HITS = "hits struct<hits: array<struct<_id: string, _source: struct<file_date: string, display_names: array<string>, ciks: array<string>>>>>"
#: Landed alert messages: headers and bodies, parts two levels deep.
MESSAGES = f"id string, payload struct<mimeType: string, headers: array<struct<name: string, value: string>>, body: struct<data: string>, parts: array<struct<mimeType: string, body: struct<data: string>, parts: array<struct<mimeType: string, body: struct<data: string>>>>>>"
FEED_ENTRIES = "feed_url string, link string, title string, summary string, published string, updated string, created string"
CHOW_COLUMNS = ["ORGANIZATION NAME - BUYER", "ORGANIZATION NAME - SELLER", "CCN - BUYER", "CHOW TYPE TEXT", "EFFECTIVE DATE", "ENROLLMENT STATE - BUYER"]
