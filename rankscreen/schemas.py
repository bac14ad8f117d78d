"""Fixed table schemas. Column names, order and types are part of the contract and are never inferred."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(*fields) -> T.StructType:
    """(name, type) pairs; a third True marks a nullable column."""
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2) for f in fields])


# The column lists below are the published table layouts.
MEASUREMENTS = _schema(
    ("code_id", _S), ("construction_program_id", _S), ("family", _S), ("params_json", _S), ("seed", _L),
    ("n", _I), ("k", _I), ("d_exact", _I, True), ("d_upper", _I), ("phi_from_d_upper", _D),
    ("n_ancilla", _I), ("n_total", _I), ("protocol_hash", _S), ("commit_sha", _S), ("sampling_seed", _L),
    ("stim_version", _S), ("cpu_class", _S), ("p", _D), ("rounds", _I), ("shots", _L), ("failures", _L),
    ("true_ler", _D, True), ("true_ler_ub", _D), ("true_ler_ci_low", _D), ("true_ler_ci_high", _D),
    ("censored", _B), ("decode_seconds", _D), ("schema_version", _I), ("created_at", _S))

_PER_SIDE = (
    ("qubit_degree_min", _I), ("qubit_degree_max", _I), ("qubit_degree_mean", _D), ("cycle4_count", _L),
    ("cycle6_count", _L), ("girth", _I), ("lambda2", _D), ("n_components", _I))

FEATURES = T.StructType([T.StructField(n, t) for n, t in (
    ("code_id", _S), ("feature_set", _S), ("n", _I), ("k", _I), ("d_upper", _I), ("phi_from_d_upper", _D),
    ("check_weight_min", _I), ("check_weight_max", _I), ("check_weight_mean", _D), ("n_ancilla", _I), ("n_total", _I),
    *[(f"{n}_{s}", t) for n, t in _PER_SIDE for s in ("x", "z")],
    ("cx_per_round", _I), ("cx_total", _I), ("circuit_ticks", _I))])
MODEL_FEATURES = [f.name for f in FEATURES if f.name not in ("code_id", "feature_set")]

PREDICTIONS = _schema(("code_id", _S), ("pred_log10_ler", _D), ("fold", _I), ("model_version", _S))

SHARDS = T.StructType([T.StructField(n, t) for n, t in (
    ("seed", _L), ("batch_size", _L), ("max_shots", _L), ("batch_index", _L), ("batch_shots", _L),
    ("batch_failures", _L), ("batch_osd_invocations", _L), ("batch_decode_seconds", _D), ("batch_samples_sha256", _S),
    ("shots", _L), ("failures", _L), ("samples_sha256", _S), ("commit_sha", _S), ("stim_version", _S),
    ("cpu_class", _S))])

RESULTS = T.StructType([T.StructField(n, t) for n, t in (
    ("seed", _L), ("batch_size", _L), ("max_shots", _L), ("shots", _L), ("failures", _L), ("stopped_by", _S),
    ("osd_invocations", _L), ("samples_sha256", _S), ("decode_seconds", _D))])

POPULATION = T.StructType([T.StructField(n, t) for n, t in (
    ("code_id", _S), ("construction_program_id", _S), ("params_json", _S), ("n", _L), ("k", _L), ("d_upper", _L),
    ("n_d_upper", _L))])

CELL_DDL = (
    "calibration boolean, status string, p double, "
    "code struct<code_id:string,name:string,construction_program_id:string,n:int,k:int,d_upper:int,l:int,m:int,"
    "a_exps:array<array<int>>,b_exps:array<array<int>>>, rounds int, shots bigint, stopped_by string, "
    "decoders map<string,struct<shots:bigint,stopped_by:string,failures:bigint,censored:boolean,ler:double,ler_ci_low:double,ler_ci_high:double,"
    "decode_seconds:double,ms_per_shot:double,bp_converged:bigint,bp_convergence_fraction:double,"
    "syndromes_sha256:string>>, paired map<string,map<string,double>>")

SESSION_DDL = (
    "session bigint, kind string, started_at string, ended_at string, "
    "died array<struct<code_id:string,exitcode:int>>, started array<string>, "
    "stale_restarted array<struct<code_id:string,reason:string,cpu_class:string,moved_to:string>>, "
    "decode_core_hours struct<this_session:double,cumulative:double>, inventory map<string,string>")

METRICS = T.StructType([T.StructField(n, t) for n, t in (
    ("metric", _S), ("scorer", _S), ("estimate", _D), ("low", _D), ("high", _D), ("n_censored", _L), ("excl_censored", _D))])
