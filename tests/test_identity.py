import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rankscreen import constants
from rankscreen.functions import identity


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_seed_golden(spark):
    assert one(spark, identity.sampling_seed(F.lit("bb_v1_ref-0123456789ab"), F.lit("a" * 64)))[0] == 6435667380748351026


@pytest.mark.parametrize("code,h", [("", "a" * 64), ("x", "A" * 64), ("x", "a" * 63)])
def test_seed_refuses(spark, code, h):
    with pytest.raises(Exception, match="a seed needs"):
        one(spark, identity.sampling_seed(F.lit(code), F.lit(h)))


@pytest.mark.parametrize("p", [0.002, 0.05, 0.1, 1.0, 0.0, 0.0015, 0.00200000001])
def test_protocol_hash_is_canonical_json(spark, p):
    settings = {
        "p": round(p, 6), "decoder_version": '2.4"x', "noise_model": constants.NOISE_MODEL, "scheduling": constants.SCHEDULING,
        "rounds_rule": constants.ROUNDS_RULE, "memory_basis": constants.MEMORY_BASIS, "schema_version": 1,
        "decoder_params": constants.DECODER_PARAMS}
    want = hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, identity.protocol_hash(F.lit(p), F.lit('2.4"x')))[0] == want


def test_protocol_hash_refuses(spark):
    for p, v in ((0.00001, "1"), (0.1, "unset"), (0.1, "")):
        with pytest.raises(Exception):
            one(spark, identity.protocol_hash(F.lit(p), F.lit(v)))


def test_params_and_ids(spark):
    a, b = [(3, 0), (0, 1), (0, 2)], [(0, 3), (1, 0), (2, 0)]
    text = one(spark, identity.canonical_params(F.lit(6), F.lit(6), identity.exps(a), identity.exps(b)))[0]
    want = json.dumps({"a_exps": a, "b_exps": b, "l": 6, "m": 6}, sort_keys=True, separators=(",", ":"))
    assert text == want
    cid = one(spark, identity.content_id(F.lit("bb_v1_sym_3_3"), F.lit(text)))[0]
    assert cid == "bb_v1_sym_3_3-" + hashlib.sha256(want.encode()).hexdigest()[:12]

    def problem(stored, code):
        return one(spark, identity.identity_problem(F.lit("bb_v1_sym_3_3"), F.lit(stored), F.lit(code)))[0]
    assert problem(text, cid) is None
    assert problem(text, "other") == "id_mismatch"
    spaced = json.dumps({"a_exps": a, "b_exps": b, "l": 6, "m": 6})
    assert problem(spaced, "bb_v1_sym_3_3-" + hashlib.sha256(spaced.encode()).hexdigest()[:12]) == "not_canonical"


def test_family(spark):
    assert one(spark, identity.family(F.lit("bb_v1_sym")), identity.family(F.lit("bb_v1"))) == ("BB", "BB")
    with pytest.raises(Exception, match="no family"):
        one(spark, identity.family(F.lit("bb_v10_x")))


def test_template_key_swap_and_shift(spark):
    a, b = [(1, 0), (0, 1), (2, 0)], [(1, 1), (2, 2)]
    shifted = [(i + 2, j + 1) for i, j in a]

    def key(x, y):
        return one(spark, F.to_json(identity.template_key(identity.exps(x), identity.exps(y))))[0]
    assert key(a, b) == key(b, a) == key(shifted, b) != key(a, a)


def test_shipped_templates_are_distinct(spark):
    keys = {one(spark, F.to_json(identity.template_key(identity.exps(a), identity.exps(b))))[0] for _, a, b in constants.TEMPLATES}
    assert len(keys) == len(constants.TEMPLATES)


def test_commit(spark):
    ok = [identity.commit_ok(F.lit(x)) for x in ("a" * 40, "b" * 64, "0" * 40, "a" * 41, "A" * 40, None)]
    assert list(one(spark, *[c.alias(str(i)) for i, c in enumerate(ok)])) == [True, True, False, False, False, False]
