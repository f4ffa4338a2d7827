"""Every query of the package on awkward and on empty tables: no crash, and the defined results."""

import pytest

from foliospark.llm import queries
from tests.fixtures import TEXTS, awkward_rows, write_tables


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("awkward"), awkward_rows(), clashes=True)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_awkward_rows(spark, awkward, name):
    queries.QUERIES[name](spark, awkward).collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_each_document_has_its_ids(spark, awkward):
    rows = queries.QUERIES["p8_ids"](spark, awkward).collect()
    assert len(rows) == len(awkward_rows()["documents"])
    by_id = {r["doc_id"]: r["ids"] for r in rows}
    assert by_id[0] == [] and by_id[1 + TEXTS.index("")] == [] and by_id[1 + TEXTS.index("a")] == [64]


def test_repeated_lines_count_urls_not_deliveries(spark, awkward):
    found = {(r["fetch_id"], r["line_no"]) for r in queries.QUERIES["p7_found"](spark, awkward).collect()}
    assert {(100 + k, 1) for k in range(12)} <= found
    assert not any(fetch >= 100 and line == 3 for fetch, line in found)
