import os

import pytest
from oracle import differences

from postmill.plans import catalogue

FOLDER = os.environ.get("POSTMILL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    assert differences(spark, FOLDER, catalogue.QUERIES[name], catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() >= 0


def test_nothing_needs_the_llm_part():
    import pathlib
    import re

    package = pathlib.Path(catalogue.__file__).parent.parent
    for path in package.rglob("*.py"):
        if "llm" not in path.relative_to(package).parts:
            assert not re.search(r"postmill\.llm|from postmill import .*llm", path.read_text()), path
