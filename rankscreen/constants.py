"""Defaults shared by every operator. Each one is also a parameter where it is used.

Fixed values: they must be these for results to agree with published numbers.
"""

MIN_FAILURES = 100
MAX_SHOTS = 40_960
SHOT_BATCH = 256
Z_95 = 1.959963984540054

BOOTSTRAP_RESAMPLES = 1_000
BOOTSTRAP_SEED = 20261001
LABEL_NOISE_DRAWS = 1_000
LABEL_NOISE_SEED = 20261002
RECALL_K = 30
RECALL_TOP_N = 10

MIN_DIM = 2
MIN_D_UPPER = 3
OPEN_AND_SWAP_TICKS = 2

FAMILY_PREFIXES = {"bb_v1": "BB"}
PROVENANCE_FIELDS = ("commit_sha", "stim_version", "cpu_class")
RUN_FIELDS = ("seed", "batch_size", "max_shots")
SHARED_COLUMNS = ("n", "k", "d_upper", "n_ancilla", "n_total")
MARKER_COLUMN = "calibration"
PHI_SCORE = "phi_from_d_upper"
MODEL_SCORE = "pred_score"

# Protocol settings that enter the protocol hash.
NOISE_MODEL = "uniform_depolarizing_v1"
SCHEDULING = "bb_monomial_matching_xz_phased_v2"
ROUNDS_RULE = "r = d_upper"
MEMORY_BASIS = "Z"
SCHEMA_VERSION = 1
DECODER_PARAMS = {
    "library": "ldpc",
    "decoder": "BpOsdDecoder",
    "bp_method": "minimum_sum",
    "max_iter": 30,
    "ms_scaling_factor": 0.625,
    "osd_method": "osd_cs",
    "osd_order": 10,
    "schedule": "parallel",
    "dem_to_matrix": "dem_undecomposed_merge_by_symptom_v1",
}

# Construction templates: name, exponents of A, exponents of B.
TEMPLATES = [
    ("sym_3_3", [(3, 0), (0, 1), (0, 2)], [(0, 3), (1, 0), (2, 0)]),
    ("pair_2_2", [(1, 0), (0, 2)], [(0, 1), (2, 0)]),
    ("quad_4_2", [(1, 0), (0, 1), (2, 0), (0, 2)], [(1, 1), (2, 2)]),
    ("rare_3_4", [(1, 2), (0, 3), (3, 0)], [(0, 1), (3, 3), (2, 3), (2, 1)]),
    ("rare_2_3", [(1, 1), (1, 3)], [(0, 1), (3, 2), (2, 1)]),
    ("mixed_3_5", [(4, 0), (0, 1), (1, 3)], [(0, 4), (1, 0), (2, 1), (3, 0), (0, 2)]),
    ("mod_2_3", [(1, 0), (2, 3)], [(2, 3), (3, 2), (2, 1)]),
    ("bb288_3_3", [(3, 0), (0, 2), (0, 7)], [(0, 3), (1, 0), (2, 0)]),
    ("tri_3_3", [(1, 0), (0, 1), (1, 1)], [(0, 0), (2, 1), (1, 2)]),
    ("diag_3_3", [(1, 0), (0, 1), (2, 2)], [(0, 0), (1, 2), (2, 1)]),
    ("sq_4_2", [(0, 0), (1, 0), (0, 1), (1, 1)], [(2, 0), (0, 3)]),
]

# Sizing knobs for the execution strategies, in rows.
ROWS_PER_BUCKET = 500_000        # target rows in one (group, bucket) window
BROADCAST_ROWS = 1_000_000       # broadcast a side only when it is counted at or below this
HOT_KEY_ROWS = 5_000_000         # a join key with more rows than this is handled apart
