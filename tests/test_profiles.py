"""Binned profiles against exact means, in every order of the lines."""

import itertools
import math

import pytest

from halocline.plans import adapters as A
from halocline.plans.chain import derived_depth_errors
from halocline.plans.profiles import isotherm_d20
from halocline.plans.serving import section_heatmap

#: (quantity, discount) of lines in one bin, and the exact mean of their temperatures.
LINES = {20.5: [(20, 0.04), (20, 0.09), (20, 0.02)], 20.0: [(21, 0.09), (21, 0.07), (22, 0.04)]}


def write(spark, path, lines, files=1):
    """Every order of an order's lines, as an order of its own, beside a warm line at the surface."""
    # the levels on both sides of the bin are there
    rows = [(k, float(q), d, "A", "F", 0.0) for k, p in enumerate(itertools.permutations(lines)) for q, d in [(lines[0][0] - 5, 0.1), *p, (lines[0][0] + 5, 0.0)]]
    schema = "l_orderkey long, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_tax double"
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("mean,files", [(20.5, 1), (20.5, 7), (20.0, 1), (20.0, 7)])
def test_the_order_of_lines_decides_nothing(spark, tmp_path, mean, files):
    lines = LINES[mean]
    temps = [30 - 0.5 * q + 10 * d for q, d in lines]
    sf = write(spark, tmp_path, lines, files)
    got = A.binned_profiles(spark, sf).collect()
    b = (lines[0][0] * 20 - 20) // 100
    assert len(got) == 6 and {r.temps[b] for r in got} == {math.fsum(temps) / len(temps)} == {mean}
    assert len({r.depth for r in isotherm_d20(spark, sf).collect()}) == 1
    assert len({tuple(r) for r in section_heatmap(spark, sf).drop("section_id").collect()}) == 18
    # one order in each group
    assert len({tuple(r)[1:] for r in derived_depth_errors(spark, sf).collect()}) == 1
