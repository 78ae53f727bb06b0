"""Fixed values.

Everything in this module is a fixed value of the domain: word lists, lookup
tables and constants that results depend on.  They are stated as plain text in
their natural order; logic lives elsewhere.
"""

# --- fixed values: skills, in reporting order -------------------------------
SKILLS = [
    "Python", "PySpark", "Spark", "SQL", "dbt", "Airflow",
    "Databricks", "Snowflake", "Azure", "AWS", "GCP", "Kafka",
    "Delta Lake", "BigQuery", "Terraform", "Docker", "Kubernetes",
    "Trino", "Flink", "Iceberg", "MLflow", "Redshift", "Hudi",
    "Unity Catalog", "ADF",
]

# --- fixed values: geography ------------------------------------------------
CANADA_TERMS = [
    "canada", "toronto", "vancouver", "calgary", "edmonton", "halifax",
    "ontario", "british columbia", "alberta", "montreal", "ottawa",
    "waterloo", "mississauga", "brampton", "quebec", "winnipeg", "burnaby",
    "kitchener", "oakville", "stellarton", "saskatoon", "st. john",
    "markham", "richmond hill", "hamilton", "london, on",
    "remote - canada", "remote – canada", "remote canada",
]
US_TERMS = [
    "united states", " usa", "u.s.a", "remote - us", "remote us",
    "remote - united states", "remote usa", "new york", "san francisco",
    "california", "seattle", "chicago", "boston", "austin", "dallas",
    "atlanta", "washington, d.c", "washington d.c", "virginia", "maryland",
    "texas", "illinois", "massachusetts", "georgia", "north carolina",
    "colorado", "pennsylvania", "ohio", "florida", "oregon", "washington",
    "minnesota", "michigan", "arizona", "remote, us",
]
DEFAULT_LOCATION = "Canada"

# --- fixed values: role rules -----------------------------------------------
ROLE_REJECT_SUBSTRINGS = ["intern", "co-op", "coop", "student", "placement"]
ROLE_REJECT_WORDS = ["manager", "managers", "director", "directors", "vp"]
ROLE_REJECT_PHRASES = [
    "head of ", "managing director", "vice president", "pre-sales", "presales",
]
ROLE_ANALYST = "data analyst"
ROLE_ANALYST_EXEMPT = "analytics engineer"
ROLE_ACCEPT = [
    "data engineer", "data platform", "analytics engineer", "big data",
    "databricks", "spark", "pyspark", "etl", "elt", "data architect",
    "dataops", "ml engineer", "machine learning engineer", "data analyst",
    "pipeline engineer", "data infrastructure", "bi engineer",
    "bi developer", "business intelligence", "data reliability",
    "cloud data", "data ops", "data management", "data product",
    "data developer", "data dev", "data governance", "ml platform",
    "machine learning platform", "mlops", "data pipeline", "data quality",
    "data integration", "data warehouse", "lakehouse", "data migration",
    "data streaming", "streaming data", "real-time data",
    "feature engineer", "feature platform", "analytics platform",
    "dbt developer", "kafka engineer", "snowflake engineer",
    "flink engineer", "airflow engineer", "bigquery engineer",
    "redshift engineer", "sql developer", "report developer",
    "solutions engineer", "solutions architect", "feeds engineer",
    "data security engineer", "vector database", "data contract",
    "ai platform engineer", "ingénieur de données", "ingénieur données",
    "data cloud", "developer advocate", "data analytics",
    "architecte de données", "forward deployed", "distributed systems",
    "production engineer", "deployment strategist", "field engineer",
    "cloud architect", "ai engineer", "llm engineer", "gen ai",
    "generative ai", "ml infrastructure", "model deployment",
    "prompt engineer", "foundation model", "applied ml",
    "applied scientist", "research engineer", "ai infrastructure",
    "inference engineer", "fine-tuning", "rag engineer", "embedding",
    "ai/ml", "customer engineer", "ml reliability",
]

# --- fixed values: seniority ------------------------------------------------
LEVEL_TERMS = [
    ("Staff / Lead", ["staff", "principal", "lead", "director", "architect"]),
    ("Senior", ["senior", " sr.", " sr ", "sr. ", "sr "]),
    ("Entry Level", ["associate", "junior", "jr.", " jr ", "jr ", " jr,",
                     "entry", " ii", " iii", " 2", " 3"]),
]
LEVEL_DEFAULT = "Mid-Level"
LEVEL_ORDER = {
    "Staff / Lead": 0, "Principal": 1, "Senior": 2, "Mid-Level": 3,
    "Entry Level": 4,
}
LEVEL_ORDER_DEFAULT = 3

# --- fixed values: digest ---------------------------------------------------
CATEGORY_ICONS = {
    "Banks": "🏦", "Fintech": "💳", "Big Tech": "💻", "Consulting": "🤝",
    "Data & Analytics": "📊", "Telecom": "📡", "Healthcare": "🏥",
    "Retail": "🛒", "Energy": "⚡", "Government": "🏛️", "Startups": "🚀",
}
CATEGORY_ICON_DEFAULT = "📁"
CATEGORY_DEFAULT = "Other"
SUBJECT_NEW = "%s: %d new postings, %s"
SUBJECT_NONE = "%s: nothing new, %s"
CHUNK_SIZE = 50
STATE_DAYS = 14

# --- fixed values: per-source location rules --------------------------------
ASHBY_CITIES = [
    "toronto", "vancouver", "montreal", "calgary", "edmonton", "ottawa",
    "waterloo", "mississauga", "brampton", "quebec", "winnipeg", "burnaby",
    "kitchener", "oakville", "stellarton", "saskatoon",
]
WORKDAY_BULLET_TERMS = [
    "canada", "toronto", "montreal", "vancouver", "ottawa", "calgary",
    "remote",
]
PHENOM_PROVINCES = [
    "ontario", "british columbia", "alberta", "quebec", "manitoba",
    "saskatchewan", "nova scotia", "new brunswick", "newfoundland",
    "prince edward island", "on", "bc", "ab", "qc", "mb", "sk", "ns", "nb",
    "nl", "pe",
]
BAMBOO_PROVINCES = [
    "british columbia", "ontario", "quebec", "alberta", "manitoba",
    "saskatchewan", "nova scotia", "new brunswick", "prince edward island",
    "newfoundland", "northwest territories", "nunavut", "yukon", "bc", "on",
    "qc", "ab", "mb", "sk", "ns", "nb", "pe", "nl",
]
BAMBOO_CITIES = [
    "toronto", "vancouver", "montreal", "calgary", "edmonton", "ottawa",
    "saskatoon", "winnipeg",
]
AVATURE_OFFICES = {
    "TOR": "Toronto, Ontario, Canada",
    "VAN": "Vancouver, BC, Canada",
    "MTL": "Montreal, Quebec, Canada",
}
SHOPIFY_LOCATION = "Remote Canada"
BOC_LOCATION = "Ottawa"

# --- fixed values: URLs -----------------------------------------------------
BROADEN_PAIRS = [
    ("data+engineer", "engineer"), ("data%20engineer", "engineer"),
    ("data engineer", "engineer"), ("keywords=data", "keywords=engineer"),
]
SMARTRECRUITERS_JOB = "https://jobs.smartrecruiters.com/"
AMAZON_HOST = "https://www.amazon.jobs"
IBM_JOB = "https://careers.ibm.com/en_US/careers/JobDetail?jobId="
META_JOB = "https://www.metacareers.com/jobs/"
SHOPIFY_CAREERS = "https://www.shopify.com/careers"
CANADALIFE_HOST = "https://jobs.canadalife.com"
APPLE_HOST = "https://jobs.apple.com"

# --- fixed values: paging ---------------------------------------------------
PAGE_SIZE = {"smartrecruiters": 100, "amazon": 100, "oracle_hcm": 25,
             "netflix": 50, "workday": 20}

# --- fixed values: routing --------------------------------------------------
API_TYPES = ["greenhouse", "lever", "workday", "phenom", "ashby",
             "smartrecruiters", "oracle_hcm", "avature"]
GENERIC = "generic"
TYPE_EXTRACTORS = {
    "greenhouse": "greenhouse", "lever": "lever", "workday": "workday",
    "phenom": "phenom", "smartrecruiters": "smartrecruiters",
    "ashby": "ashby", "avature": "avature", "oracle_hcm": "oracle_hcm",
    "custom": "generic",
}
DEDICATED_EXTRACTORS = {
    "Google Canada": "google", "Amazon / AWS Canada": "amazon",
    "Microsoft Canada": "microsoft", "Meta Canada": "meta",
    "Apple Canada": "apple", "Netflix Canada": "netflix",
    "Shopify": "shopify", "IBM Canada": "ibm", "Scotiabank": "scotiabank",
    "EY Canada": "ey", "Lululemon Canada": "lululemon", "CGI Group": "njoyn",
    "McKinsey Canada": "mckinsey", "Citibank Canada": "citibank",
    "Deloitte Canada": "j2w", "SAP Canada": "j2w", "TELUS Health": "j2w",
    "Scotiabank Digital Factory": "j2w", "Bank of Canada": "boc_rss",
    "Atlassian Canada": "atlassian", "Questrade": "dayforce",
    "LifeLabs": "dayforce", "MindBridge AI": "dayforce",
    "Vendasta": "bamboohr", "iA Financial Group": "ia_financial",
    "PayPal Canada": "paypal", "WELL Health Technologies": "well_health",
    "Stantec": "stantec", "Pfizer Canada": "pfizer", "Klick Health": "klick",
    "HCL Technologies Canada": "j2w", "Cognizant Canada": "cognizant",
    "TCS Canada": "tcs", "Wipro Canada": "j2w", "Capgemini Canada": "j2w",
    "Uber Canada": "uber", "Intuit Canada": "intuit", "Clio": "clio",
    "Coveo": "coveo", "Kinaxis": "icims", "City of Toronto": "j2w",
    "Infosys Canada": "infosys", "Great-West Lifeco": "canadalife",
    "KPMG Canada": "icims", "Mackenzie Investments": "icims",
}
# Companies the health audit never probes: they need a rendered page.
AUDIT_RENDERED_ONLY = [
    "Google Canada", "Meta Canada", "Apple Canada", "Netflix Canada",
    "Shopify", "IBM Canada", "Scotiabank", "Microsoft Canada", "Uber Canada",
    "Deloitte Canada", "SAP Canada", "TELUS Health",
    "Scotiabank Digital Factory", "HCL Technologies Canada", "Wipro Canada",
    "Capgemini Canada", "City of Toronto", "Kinaxis",
    "Mackenzie Investments", "Questrade", "LifeLabs", "MindBridge AI",
    "Atlassian Canada", "Intuit Canada", "Clio", "Coveo", "TCS Canada",
    "Cognizant Canada", "iA Financial Group", "PayPal Canada",
    "Oracle Canada", "WELL Health Technologies", "Stantec", "Pfizer Canada",
    "Klick Health", "Infosys Canada", "KPMG Canada",
]
# Companies whose configured greenhouse slug is known good: no alternates.
VERIFIED_SLUGS = [
    "Databricks Canada", "Fivetran Canada", "Geotab", "dbt Labs Canada",
    "Airbnb Canada", "Datadog Canada", "MongoDB Canada",
    "Borealis AI (RBC)", "Wayfair Canada",
]
RUN_LABELS = {"morning": "Morning (9 AM)", "evening": "Evening (6 PM)",
              "daily": "Daily"}
