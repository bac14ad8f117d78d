import os
import re

import pytest

import check_queries
from rankscreen.catalog import ENTRIES

SMALL = "/root/testdata/sf0.001"
# Cheap enough for every test run; check_queries.py runs all of them.
QUICK = ["ranking_report", "label_measurements", "sequential_stopping", "paired_contingency", "treatment_tally", "tolerant_labels",
         "sampling_seeds", "protocol_hashes", "guard_counts", "exclusion_problems", "table_digest", "top_third_by_size",
         "bootstrap_replicates", "population_projection", "cycle_counts", "segment_components", "merged_mechanisms",
         "assembled_measurements", "guarded_assembly", "calibration_pairs", "calibration_status_counts", "foreign_cells",
         "balanced_sample", "balanced_sample_report", "undefined_values", "manifest_differences", "grouped_folds", "streaming_stopping",
         "streaming_provenance", "streaming_snapshot"]


@pytest.fixture(scope="module")
def duck():
    return check_queries.duck(SMALL)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, duck, name):
    entry = ENTRIES[name]
    assert check_queries.compare(entry.run(spark, SMALL), duck, entry.sql) is None


def test_every_operator_of_the_inventory_is_covered():
    covered = {c for e in ENTRIES.values() for c in e.covers}
    wanted = ([f"S{i}" for i in range(1, 11)] + [f"P{i}" for i in range(1, 27)] + [f"F{i}" for i in range(1, 25)]
              + [f"J{i}" for i in range(1, 12)] + ["X1", "X2", "X3"] + [f"A{i}" for i in range(1, 22)] + [f"W{i}" for i in range(1, 15)]
              + [f"M{i}" for i in range(1, 14)] + [f"L{i}" for i in range(1, 5)] + [f"G{i}" for i in range(1, 10) if i != 7]
              + [f"R{i}" for i in range(1, 7)] + ["U1", "U2", "U3"])
    assert sorted(set(wanted) - covered) == []


def test_no_local_checkpoints_or_cross_joins_in_the_library():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rankscreen")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert not re.search(r"localCheckpoint|crossJoin|toPandas|\.rdd\b", text), f
