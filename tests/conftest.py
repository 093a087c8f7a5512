import pathlib
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("quietkey-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quietkey-tests-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="quietkey-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FILES = (
    "project_id string, path string, length bigint, is_symlink boolean, readable boolean, "
    "content binary"
)


def file_row(path, content, project="p", length=None, link=False, readable=True):
    data = content.encode() if isinstance(content, str) else content
    size = len(data) if length is None and data is not None else length
    return (project, path, size, link, readable, data)


@pytest.fixture
def scan(spark):
    """Scan (path, content) pairs or full rows of one project; returns ordered rows."""
    from quietkey.plans.scan import scan_projects

    def run(*files, rules=None):
        rows = [f if len(f) == 6 else file_row(*f) for f in files]
        frame = spark.createDataFrame(rows, FILES)
        table = None
        if rules is not None:
            table = spark.createDataFrame([("p", rules)], "project_id string, patterns array<string>")
        return scan_projects(frame, table).public(ordered=True).collect()

    return run
