import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def block_lines(spark):
    # fixed values: the golden block fixture
    return spark.createDataFrame(
        [
            ("0\t1#2#3#4#5#;-1#-2#-3#-4#-5#",),
            ("1\t3#4#5#;-1#-5#",),
            ("2\t5#;-5#",),
            ("3\t5#;",),
        ],
        "value string",
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def ranked(spark, lists):
    """Candidate lists {entity: [(candidate, score), ...]} as a DataFrame."""
    data = [
        (entity, cand, float(score), rank)
        for entity, items in lists.items()
        for rank, (cand, score) in enumerate(items, 1)
    ]
    return spark.createDataFrame(data, "entity_id bigint, cand_id bigint, score double, rank int")


def pairs(spark, data):
    return spark.createDataFrame(data, "d2_id bigint, d1_id bigint")
