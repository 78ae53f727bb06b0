"""Schemas of the tables the jobs exchange."""

POSTING_COLUMNS = [
    "title", "company", "category", "location", "level", "type", "posted",
    "url", "skills", "salary",
]
POSTING_SCHEMA = (
    "title string, company string, category string, location string, "
    "level string, type string, posted string, url string, "
    "skills array<string>, salary string"
)
COMPANY_SCHEMA = (
    "name string, careers_url string, category string, scraper string, "
    "salary_range string, top100 boolean, titles array<string>, "
    "stack array<string>, locations array<string>"
)
RAW_PAYLOAD_SCHEMA = (
    "source string, company string, attempt int, page_no int, status int, "
    "fetched_at timestamp, body string"
)
SOURCE_CONFIG_SCHEMA = (
    "company string, source string, slug string, site string, "
    "location_id string, url_template string, default_location string"
)
SEEN_SCHEMA = "fp string, emitted_at timestamp"

_PLACE = "location: string, address: struct<postalAddress: struct<addressCountry: string, addressLocality: string, addressRegion: string>>"

# Payload bodies: only the fields that are read, so from_json skips the rest.
BODY = {
    "greenhouse": "jobs array<struct<title: string, location: variant, absolute_url: string, content: string>>",
    "lever": "array<struct<text: string, categories: struct<location: string>, hostedUrl: string, descriptionPlain: string, additionalPlain: string>>",
    "ashby": f"jobs array<struct<title: string, {_PLACE}, secondaryLocations: array<struct<{_PLACE}>>, jobUrl: string, applyUrl: string, descriptionPlain: string, descriptionHtml: string>>",
    "smartrecruiters": "totalFound long, content array<struct<id: string, name: string, location: struct<fullLocation: string, country: string, city: string>>>",
    "workday": "total long, jobPostings array<struct<title: string, locationsText: string, primaryLocation: string, bulletFields: array<string>, externalPath: string, postedOn: string>>",
    "oracle_hcm": "items array<struct<TotalJobsCount: long, requisitionList: array<struct<Id: string, Title: string, PrimaryLocation: string, PrimaryLocationCountry: string, PostedDate: string>>>>",
    "amazon": "hits long, jobs array<struct<title: string, location: string, job_path: string, posted_date: string>>",
    "netflix": "count long, positions array<struct<name: string, location: string, canonicalPositionUrl: string>>",
    "ibm": "jobs array<struct<title: string, jobTitle: string, location: string, primaryLocation: string, url: string, applyUrl: string, jobId: string>>, results array<struct<title: string, jobTitle: string, location: string, primaryLocation: string, url: string, applyUrl: string, jobId: string>>",
    "meta": "data struct<job_search_with_featured_jobs: struct<all_jobs: array<struct<id: string, title: string, locations: array<string>>>>>",
    "bamboohr": "result array<struct<id: string, jobOpeningName: variant, title: variant, location: variant>>",
}
