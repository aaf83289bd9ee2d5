"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from plectra.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def canon(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "null"
        return f"{float(v):.5f}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False))


#: One or two of each family; the driver compares all of them.
SOME = [
    "flt_mapq", "prj_whole_genome_pos", "join_frag", "join_site_distance", "stat_pairs", "agg_bin_contacts", "agg_whole_genome", "flt_region",
    "agg_expected_scale", "norm_vc", "q_oeratio_p1", "q_logvs", "mat_spmv", "mat_pearson", "iv_intersect", "iv_retain_best", "iv_merge",
    "f2d_symdiff", "set_compare_lists", "f2d_loop_domain", "apa_stats", "trk_tumbling_bin", "asm_lift", "track_lift", "src_pairs_medium", "src_bedpe", "entry_region_oe",
    "motif_unique", "motif_inferred", "chrom_column_sum", "chk_validate", "mat_elementwise", "apa_stack", "apa_resample", "sink_npy", "sink_matrix_txt", "src_wig", "asm_toggle", "stat_merge",
]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(name, spark, duck, sf_dir):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_every_oracle_is_sql():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
