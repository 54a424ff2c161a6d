"""What the plans of large tables move: shuffles above the largest table's scans, when no join is small enough to be broadcast."""

import pytest

from quarryline.plans.mapping import Levels
from quarryline.plans.queries import QUERIES
from quarryline.sources import metadata
from tests.conftest import SF_DIR


@pytest.fixture
def moved(spark):
    """For each scan of a table that has the column, the shuffles that its rows pass."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def count(df, column: str) -> list[int]:
        found, above = [], []
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            depth = len(line) - len(line.lstrip(" :+-*("))
            depth = line.index("- ") if "- " in line[: depth + 1] else 0
            above = [x for x in above if x[0] < depth] + [(depth, "Exchange " in line and "Reused" not in line)]
            if "FileScan" in line and column in line:
                found.append(sum(e for _, e in above))
        return found

    yield count
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("query", "shuffles"), [("blobs_of_tree_entries", [2]), ("full_chain", [3]), ("first_blobs_sorted", [1])])
def test_line_items_are_read_and_moved_once_a_join(spark, moved, query, shuffles):
    assert moved(QUERIES[query](spark, SF_DIR), "l_orderkey") == shuffles


def test_a_snapshot_moves_line_items_once(spark, moved):
    entries = Levels(spark, SF_DIR).whole("tree_entries").select("commit_hash", "path", "blob")
    assert moved(entries.distinct(), "l_orderkey") == [1]
    once = metadata._once(entries).sortWithinPartitions("commit_hash")
    assert moved(once, "l_orderkey") == [1]
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [commit_hash") == 1


def test_a_loaded_snapshot_moves_places_of_commits_once(spark, moved, tmp_path):
    metadata.save(spark, Levels(spark, SF_DIR).whole, str(tmp_path))
    assert moved(metadata.load(spark, str(tmp_path))["tree_entries"], "reference_name") == [1]


def test_entries_are_kept_once(spark):
    rows = [("1", "a", "x"), ("1", "a", "x"), ("1", "a", None), ("1", "a", None), ("1", "b", "x"), ("2", "a", "x"), (None, "a", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows * 3, "commit_hash string, path string, blob string").repartition(5)
    kept = metadata._once(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.distinct().collect()))
