"""Fixed values of the derivation: literal arrays, indexes are 0-based."""

# --- fixed values: titles, one per rule of role and level -------------------
TITLES = [
    "Senior Data Engineer", "Data Engineer", "Data Engineer II",
    "Data Engineer III", "Data Engineer Level 2", "Principal Data Engineer",
    "Staff Data Engineer", "Lead Data Engineer", "Data Architect",
    "Analytics Engineer", "Sr. Analytics Engineer", "Data Engineer Sr ",
    "Junior Data Engineer", "Jr. ETL Developer", "Associate BI Developer",
    "Data Analyst", "Data Analyst / Analytics Engineer",
    "Senior Data Analytics Engineer", "Data Product Manager",
    "Director, Data Platform", "VP, Data Platform", "Head of Data Platform",
    "Managing Director, Big Data", "Vice President Data Quality",
    "Presales Solutions Engineer", "Data Engineer Intern",
    "Internal Data Engineer", "Data Engineering Co-op",
    "Student, Data Warehouse", "Data Scientist",
    "Data Scientist, ML Platform", "Delta Force Rep",
    "Ingénieur de données", "Intermediate Data Engineer", "MLOps Engineer",
    "Backend Developer", "QA Engineer", "  Kafka Engineer\t",
    "Spark Platform Engineer 3", "Generative AI Applied Scientist",
]
# --- fixed values: locations ------------------------------------------------
LOCATIONS = [
    "Toronto, ON", "Vancouver, BC", "Calgary, Alberta", "Edmonton",
    "Halifax, NS", "Montreal, QC", "Montréal", "Ottawa, Canada",
    "Waterloo, Ontario", "Mississauga", "Quebec City", "Winnipeg",
    "Burnaby, BC", "Saskatoon", "St. John's", "London, ON", "London, UK",
    "Remote - Canada", "Remote Canada",
    "Remote - California; Remote - Canada", "Ontario, California",
    "New York, NY", "San Francisco, CA", "Austin, Texas", "Remote - US",
    "Washington, D.C.", "Berlin, Germany", "Bangalore, India",
    "  Markham  ", "", "CANADA", "Gatineau",
]
# --- fixed values: texts that name tools ------------------------------------
SNIPPETS = [
    "Python SQL", "PySpark and dbt", "Airflow, Snowflake, AWS",
    "mysql administration", "Delta Lake on Azure Databricks",
    "Kafka Flink Iceberg", "Terraform Docker Kubernetes", "no tools named",
    "Unity Catalog ADF",
    "Python PySpark SQL dbt Airflow Databricks Snowflake Azure",
    "BigQuery GCP", "<b>Redshift</b> &amp; Hudi",
]
# --- fixed values: categories -----------------------------------------------
CATEGORIES = [
    "Banks", "Fintech", "Big Tech", "Consulting", "Data & Analytics",
    "Telecom", "Healthcare", "Retail", "Energy", "Government", "Startups",
    "ML & AI", "Gaming", "Media", "Quant & HFT", "Defense & Auto",
]
# --- fixed values: board types and technology stacks of derived companies ---
TYPES = ["greenhouse", "lever", "workday", "phenom", "ashby",
         "smartrecruiters", "oracle_hcm", "avature", "custom"]
STACKS = [
    ["Azure", "Databricks", "Spark", "Python", "dbt"],
    ["AWS", "Snowflake", "Python", "dbt"],
    ["GCP", "BigQuery", "Python", "dbt", "Spark", "Kafka"],
]
# Companies a digest says it monitors.
MONITORED = 50
PAGE_ROWS = 2000
