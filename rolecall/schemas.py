"""Table layouts. Times are UTC; NULL always means "not known"."""
# The posting record, in export order.
POSTING_FIELDS = ["company", "title", "url", "location", "remote", "department", "posted", "source",
                  "workplace", "employment_type", "city", "region", "country", "geo_confidence"]
WORKPLACES = ["remote", "hybrid", "onsite"]
EMPLOYMENT_TYPES = ["full_time", "part_time", "contract", "intern", "other"]
FACETS = ["workplace", "employment_type", "country", "department", "source", "domain"]
LIVE_RUN_STATUSES = ["running", "done", "stopped"]
UNKNOWN = "unknown"

_TYPES = {"remote": "BOOLEAN", "posted": "TIMESTAMP"}
POSTING = ", ".join(f"{f} {_TYPES.get(f, 'STRING')}" for f in POSTING_FIELDS)

RUNS = ("run_id BIGINT, domain STRING, company STRING, source STRING, status STRING, complete BOOLEAN, "
        "started_at TIMESTAMP, finished_at TIMESTAMP, jobs_count BIGINT, new_count BIGINT, "
        "session_id STRING, outcome STRING, outcome_detail STRING")

POSTINGS = (f"posting_id BIGINT, url_key STRING, domain STRING, {POSTING}, first_seen TIMESTAMP, last_seen TIMESTAMP, "
            "missing_since TIMESTAMP, closed_at TIMESTAMP, last_run_id BIGINT")

RUN_POSTINGS = "run_id BIGINT, posting_id BIGINT, is_new BOOLEAN"

PAGES = ("domain STRING, url STRING, final_url STRING, status INT, html STRING, error STRING, "
         "fetched_at TIMESTAMP, json_urls ARRAY<STRING>")

API_RESPONSES = ("domain STRING, ats STRING, token STRING, endpoint STRING, page_offset INT, status INT, "
                 "body STRING, fetched_at TIMESTAMP")

SESSIONS = "session_id STRING, started_at TIMESTAMP, ended_at TIMESTAMP, app_version STRING"
