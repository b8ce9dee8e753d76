import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kveil.operators.hierarchy import Hierarchy  # noqa: E402
from kveil.session import local_session  # noqa: E402
from kveil.sources.config import DGH_SCHEMA, Roles, category, numeric  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # tables are tiny: few tasks, and no time spent on compiling plans that run once
    settings = {
        "spark.default.parallelism": "2",
        "spark.sql.shuffle.partitions": "3",
        "spark.sql.codegen.wholeStage": os.environ.get("TEST_CODEGEN", "false"),
    }
    session = local_session("tests", "8", settings=settings)
    yield session
    session.stop()


# The person table, its clusters and its hierarchies.
PEOPLE = [
    (1, 39, "White", "Male", "State-gov", "<=50K", "Cluster 3"),
    (2, 50, "White", "Male", "Self-emp-not-inc", "<=50K", "Cluster 3"),
    (3, 38, "White", "Male", "Private", "<=50K", "Cluster 2"),
    (4, 53, "Black", "Male", "Private", "<=50K", "Cluster 3"),
    (5, 28, "Black", "Female", "Private", "<=50K", "Cluster 1"),
    (6, 37, "White", "Female", "Private", "<=50K", "Cluster 2"),
    (7, 49, "Black", "Female", "Private", "<=50K", "Cluster 1"),
    (8, 52, "White", "Male", "Self-emp-not-inc", ">50K", "Cluster 2"),
    (9, 31, "White", "Female", "Private", ">50K", "Cluster 1"),
]
PEOPLE_SCHEMA = "id int, age int, race string, sex string, workclass string, income string, Cluster string"
TREES = {
    "race": [
        ("Person", "Person", 1),
        ("Oriental", "Person", 2),
        ("General", "Person", 2),
        ("Amer-Indian-Eskimo", "Oriental", 3),
        ("Asian", "Oriental", 3),
        ("White", "General", 3),
        ("Black", "General", 3),
    ],
    "sex": [("Adult", "Adult", 1), ("Female", "Adult", 2), ("Male", "Adult", 2)],
    "workclass": [
        ("Employee", "Employee", 1),
        ("Gov-employee", "Employee", 2),
        ("Local-employee", "Employee", 2),
        ("Gov", "Gov-employee", 3),
        ("Other-gov", "Gov-employee", 3),
        ("Self-emp", "Local-employee", 3),
        ("Others", "Local-employee", 3),
        ("State-gov", "Government", 4),
        ("Federal-gov", "Government", 4),
        ("Self-emp-not-inc", "Self-emp", 4),
        ("Self-emp-inc", "Self-emp", 4),
        ("Private", "Others", 4),
        ("Never-worked", "Others", 4),
        ("Local-gov", "Others-gov", 4),
        ("Without-pay", "Others-gov", 4),
    ],
}
ROLES = Roles(
    quasi=(numeric("age"), category("race"), category("sex"), category("workclass")),
    sensitive=(category("income"),),
)


def dgh_rows(trees):
    return [(a, v, p, level, None) for a, rows in trees.items() for v, p, level in rows]


@pytest.fixture(scope="session")
def people(spark):
    return spark.createDataFrame(PEOPLE, PEOPLE_SCHEMA).cache()


@pytest.fixture(scope="session")
def dgh(spark):
    return spark.createDataFrame(dgh_rows(TREES), DGH_SCHEMA)


@pytest.fixture(scope="session")
def hierarchy(dgh):
    return Hierarchy.build(dgh)


@pytest.fixture(scope="session")
def roles():
    return ROLES


def tuples(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
