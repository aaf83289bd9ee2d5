"""Loop queries over whole chromosomes."""

import math

import numpy as np

from plectra.plans import q_models, registry
from plectra.plans.q_maps import contacts


def test_p_values_of_every_cell(spark, sf_dir):
    kernel = {(r.chr, r.i, r.j): r for r in q_models._kernel(spark, contacts(spark, sf_dir, sizes=(2500,))).collect()}
    rows = {(r.chr, r.i, r.j): r for r in registry.QUERIES["loop_pvalue"](spark, sf_dir).collect()}
    assert set(rows) == set(kernel) and max(i for _, i, _ in rows) >= 70
    for key in sorted(rows)[::50]:
        o, e = int(kernel[key].observed), kernel[key].donut
        if np.isfinite(e) and 0 < e < 500:
            below = sum(math.exp(-e + k * math.log(e) - math.lgamma(k + 1)) for k in range(o))
            assert abs(rows[key].p_donut - (1 - below)) < 1e-5
