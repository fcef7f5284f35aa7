import os
import re

import pytest

from spotlake.catalog import load
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")

SAMPLE = ["src_08_gmt_scan", "fil_11_spot_qc", "fn_05_grid_normalise", "join_04_knn_edges", "agg_05_pathway_scores",
          "agg_08_morans_all_genes", "agg_21_pcc_loss", "win_07_early_stop", "top_01_vocabulary", "set_05_merge_last_wins",
          "prep_01_patient_split", "str_02_stream_upsert", "plan_01_pathway_activities", "plan_04_evaluation_overall"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, con, name):
    queries, oracles = load()
    assert compare(spark, con, queries[name], oracles[name], SF).startswith("ok")


def test_names():
    queries, oracles = load()
    assert set(oracles) <= set(queries) and len(queries) >= 140
    assert not [n for n in queries if re.match(r"(pipeline|op\d)", n)]
