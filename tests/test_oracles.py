"""Queries against the same rows made by another engine, on small tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from hyperloom.plans import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A part of every block; all of them are compared by the driver.
NAMES = [
    "src5_pair_marks", "src8_admit_recordings", "prj3_derive_pairs", "flt3_drop_margins", "joi1_label_by_interval", "win1_sliding_windows", "win3_window_labels", "fea4_zero_cross", "fea8_perm_entropy", "nrm1_minmax_levels",
    "smp1_balance", "rch3_event_to_event", "cv2_rolling", "hv3_scale_rand_memory", "hv8_flip_rotate", "enc3_ch_feat_val", "enc8_feat_val_rot", "trn6_retrain_pass", "prd8_score_summary", "prd10_confidence_grid",
    "smo2_merge_close", "evt1_label_events", "evt7_metrics12", "agg6_wilcoxon", "sel5_vote_topk", "sel12_sel13_divergence", "sim4_similarity_summary", "gen3_general_leave_one_out", "str1_window_features", "str3_score_stream",
    "prd4_nearest_centroids", "trn9_centroid_update", "trn11_removal_scores", "trn12_merge_step", "trn14_prd9_knn", "enc14_multi_feature", "enc15_fft", "enc12_lbp", "fea3_band_power_rows", "fea7_sample_entropy_rounded",
    "fea14_spectrum_rows", "evt3_episode_counts", "evt6_36_scores", "evt8_scores_per_element", "smo4_best_threshold", "snk6_pairing_log", "str4_train_stream", "str5_smoothed_events", "str5_bayes_events", "rch1_rechunk_fixed", "fea11_cwt_symbol",
    "smo4_threshold_scores", "smo4_episode_threshold", "str4_online_models", "trn14_boosted_stumps", "trn14_prd9_boosted", "fea17_percentile_range", "nrm2_percentile_levels", "sel8_agreement", "sel9_prediction_overlap", "prd1_nearest_class",
    "evt2_match_events", "gen5_evolution_over_orders", "gen6_compare_rules", "sim4_similarity_histogram", "fea11_cwt_symbol_over_noise",
]


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        try:
            df[c] = df[c].astype(float).round(5)
        except (TypeError, ValueError):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    pd.testing.assert_frame_equal(plain(QUERIES[name](spark, DIR).toPandas()), plain(con.sql(ORACLES[name]).df()), check_dtype=False, atol=2e-5)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 130
