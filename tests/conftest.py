import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dim(spark):
    rows = [
        ("A", "https://a.wd3.myworkdayjobs.com/Board?q=x", "Banks", "workday", "$1K-$2K", True, [], ["Azure", "SQL"], []),
        ("B", "https://b.example/jobs", "Retail", "custom", "", False, None, None, None),
    ]
    from hiretide.schemas import COMPANY_SCHEMA
    from hiretide.sources.companies import with_defaults

    return with_defaults(spark.createDataFrame(rows, COMPANY_SCHEMA))


@pytest.fixture(scope="session")
def cfg(spark):
    from hiretide.schemas import SOURCE_CONFIG_SCHEMA

    sources = ["greenhouse", "lever", "ashby", "smartrecruiters", "phenom", "oracle_hcm", "avature", "bamboohr"]
    rows = [("A", s, "slug-a", "CX_1", None, "https://a.example/{jobSeqNo}/{slug}", None) for s in sources]
    return spark.createDataFrame(rows, SOURCE_CONFIG_SCHEMA)


@pytest.fixture(scope="session")
def payload(spark):
    from datetime import datetime

    from hiretide.schemas import RAW_PAYLOAD_SCHEMA

    def make(source, *bodies, company="A", status=200):
        rows = [(source, company, 0, i, status, datetime(2024, 1, 1), b) for i, b in enumerate(bodies)]
        return spark.createDataFrame(rows, RAW_PAYLOAD_SCHEMA)

    return make
