"""Content ids, protocol hashes, seeds and canonical forms as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from ..constants import (
    DECODER_PARAMS, FAMILY_PREFIXES, MEMORY_BASIS, NOISE_MODEL, ROUNDS_RULE, SCHEDULING, SCHEMA_VERSION,
)
from .rates import _col

EXPS = "array<struct<i:int,j:int>>"


def exps(pairs) -> Column:
    """A literal exponent list."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs]).cast(EXPS)


def canonical_params(l="l", m="m", a_exps="a_exps", b_exps="b_exps") -> Column:
    """Parameters as JSON with sorted keys and no spaces; integers only, so the text is canonical."""
    def pairs(e):
        return F.transform(_col(e), lambda x: F.array(x["i"], x["j"]))
    return F.to_json(F.struct(pairs(a_exps).alias("a_exps"), pairs(b_exps).alias("b_exps"),
                              _col(l).alias("l"), _col(m).alias("m")))


def parse_params(text="params_json") -> Column:
    """struct(a_exps, b_exps, l, m) with exponents as structs, or null when it cannot be read."""
    raw = F.from_json(_col(text), "a_exps array<array<int>>, b_exps array<array<int>>, l int, m int")

    def structs(e):
        return F.transform(e, lambda x: F.struct(x[0].alias("i"), x[1].alias("j"))).cast(EXPS)

    return F.struct(structs(raw["a_exps"]).alias("a_exps"), structs(raw["b_exps"]).alias("b_exps"),
                    raw["l"].alias("l"), raw["m"].alias("m"))


def content_id(program, params) -> Column:
    return F.concat(_col(program), F.lit("-"), F.substring(F.sha2(_col(params), 256), 1, 12))


def family(program, prefixes: dict[str, str] = FAMILY_PREFIXES, *, strict: bool = True) -> Column:
    """Family of a program by prefix. ``prefixes`` is a short configuration table, so it becomes a case expression."""
    program = _col(program)
    out = None
    for prefix, name in sorted(prefixes.items()):
        hit = (program == prefix) | program.startswith(prefix + "_")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    if strict:
        out = out.otherwise(F.raise_error(F.concat(F.lit("no family for program "), program)))
    return out


def identity_problem(program="construction_program_id", params="params_json", stored="code_id") -> Column:
    """Null when a stored id and its canonical parameters agree, else what is wrong."""
    parsed = parse_params(params)
    again = canonical_params(parsed["l"], parsed["m"], parsed["a_exps"], parsed["b_exps"])
    return (F.when(content_id(program, params) != _col(stored), F.lit("id_mismatch"))
            .when(again.isNull() | (again != _col(params)), F.lit("not_canonical")))


def decimal_text(x, digits: int = 6) -> Column:
    """A double written plainly to at most ``digits`` decimals, at least one kept: 0.05, 0.0, 1.0."""
    trimmed = F.regexp_replace(F.format_string(f"%.{digits}f", _col(x)), "0+$", "")
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def protocol_json(p, decoder_version, *, noise_model=NOISE_MODEL, scheduling=SCHEDULING, rounds_rule=ROUNDS_RULE,
                  memory_basis=MEMORY_BASIS, schema_version=SCHEMA_VERSION, decoder_params=None) -> Column:
    """Canonical JSON of the settings that make measurements comparable.

    ``p`` and ``decoder_version`` are columns; the rest are text columns or plain values. A p that has no plain
    decimal form at six places (non-zero below 1e-4) is refused, because its text would not be canonical.
    """
    p, decoder_version = F.bround(_col(p), 6), _col(decoder_version)
    params = json.dumps(decoder_params or DECODER_PARAMS, sort_keys=True, separators=(",", ":"))

    def text(v):
        return F.to_json(F.array(v if isinstance(v, Column) else F.lit(v)))

    def quoted(v):
        t = text(v)
        return F.substring(t, F.lit(2), F.length(t) - 2)

    p_text = F.when((p == 0) | (p >= 1e-4), decimal_text(p)).otherwise(
        F.raise_error(F.lit("p must be 0 or at least 1e-4 to be written canonically")))
    version = F.when((decoder_version != "") & (decoder_version != "unset"), quoted(decoder_version)).otherwise(
        F.raise_error(F.lit("decoder_version must be a real version")))
    fields = [
        ("decoder_params", F.lit(params)), ("decoder_version", version), ("memory_basis", quoted(memory_basis)),
        ("noise_model", quoted(noise_model)), ("p", p_text), ("rounds_rule", quoted(rounds_rule)),
        ("scheduling", quoted(scheduling)), ("schema_version", F.lit(str(schema_version))),
    ]
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def protocol_hash(p, decoder_version, **settings) -> Column:
    return F.sha2(protocol_json(p, decoder_version, **settings), 256)


def sampling_seed(code_id, protocol) -> Column:
    """63-bit seed from sha256(id|hash); refuses an empty id or anything but a 64-digit hash."""
    code_id, protocol = _col(code_id), _col(protocol)
    head = F.substring(F.sha2(F.concat(code_id, F.lit("|"), protocol), 256), 1, 16)
    # Clearing the top bit of the first hex digit leaves 63 bits, which fit a long.
    top = F.lpad(F.conv(F.conv(F.substring(head, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7)).cast("string"), 10, 16), 1, "0")
    value = F.conv(F.concat(top, F.substring(head, 2, 15)), 16, 10).cast("long")
    ok = (F.length(code_id) > 0) & protocol.rlike("^[0-9a-f]{64}$")
    return F.when(ok, value).otherwise(F.raise_error(F.lit("a seed needs an id and a 64-digit lowercase hash")))


def commit_ok(commit) -> Column:
    """A 40- or 64-digit lowercase hex object id that is not all zeros."""
    c = F.coalesce(_col(commit), F.lit(""))
    return c.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$") & ~c.rlike("^0+$")


def _at_origin(e: Column) -> Column:
    lo = F.array_min(e)  # the smallest (i, j) pair, which is not always the two separate minima
    return F.array_sort(F.transform(e, lambda x: F.struct((x["i"] - lo["i"]).alias("i"), (x["j"] - lo["j"]).alias("j"))))


def template_key(a_exps="a_exps", b_exps="b_exps") -> Column:
    """Canonical form of a template under exchange of A and B and a shift of either: struct(a, b)."""
    a, b = _at_origin(_col(a_exps)), _at_origin(_col(b_exps))
    return F.least(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))


def row_digest(*columns) -> Column:
    """sha256 of a row as canonical JSON of the named columns, in that order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*[_col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
