"""Templates are dealt once, by their key; nothing made of them is dealt again or sent whole to a task."""

import re

import pytest
from oracle import SF_DIR

from quire.queries import QUERIES

ONE_DEAL = ["f16_cell_parse", "g1_header_rows", "g2_targets", "g3_j14_pairs", "g4_double_pairs", "g5_g6_tables", "g7_above_headers", "g8_section_label_rows", "g9_transposed", "g10_parallel_groups", "g11_modes", "g17_context_risk", "g19_region_json"] + ["g12_roles", "g12_j15_roles_merged", "g12_w1_row_sections", "w14_column_headers", "g13_g14_column_groups", "g16_template_types", "g18_cell_maps", "t4_group_order"]


@pytest.mark.parametrize("name", ONE_DEAL)
def test_cells_stay_where_their_template_is(spark, capsys, name):
    QUERIES[name](spark, SF_DIR).explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan
    dealt = re.findall(r"Exchange (\w+)\((\S*?)#", plan)
    assert dealt and set(dealt) == {("hashpartitioning", "c_custkey")}
