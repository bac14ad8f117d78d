"""Second-smallest eigenvalue of the normalised Laplacian of many bipartite graphs at once, on their edge table.

With M the edge weights 1 / sqrt(check degree * qubit degree), the eigenvalue is one minus M's second singular value. The
first one is known (one, with vector sqrt(check degree)), so a Lanczos recurrence on M M^T, kept orthogonal to that
vector, finds the second as its largest eigenvalue. A step is two joins with the edges, one table of vectors over the
checks and one row of coefficients per graph. Small three-diagonal matrices of coefficients give the eigenvalue and a
bound of its error; a graph leaves the recurrence once the bound is below the tolerance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import scratch
from ..functions import rng

G = ["item", "side"]
#: A remainder this short, of unit vectors, is rounding: the vectors found so far span all there is.
_CLOSED = 1e-7


def largest(alphas: Sequence[float], betas: Sequence[float]) -> tuple[float, float]:
    """Largest eigenvalue of the three-diagonal matrix, and the last component of its unit vector, by bisection.

    ``betas`` are the entries beside the diagonal, one fewer than ``alphas``.
    """
    reach = [abs(a) + abs(b) + abs(c) for a, b, c in zip(alphas, [0.0, *betas], [*betas, 0.0])]
    low, high = -max(reach), max(reach)
    for _ in range(100):
        middle = (low + high) / 2
        pivot, above = 1.0, 0
        for a, b in zip(alphas, [0.0, *betas]):
            pivot = middle - a - b * b / pivot
            pivot = pivot if pivot else 1e-300
            above += pivot < 0
        low, high = (middle, high) if above else (low, middle)
    # From the last component backwards, rescaled so that nothing overflows.
    vector = [1.0]
    for j in range(len(alphas) - 1, 0, -1):
        after = betas[j] * vector[-2] if len(vector) > 1 else 0.0
        vector.append(((high - alphas[j]) * vector[-1] - after) / betas[j - 1])
        size = max(map(abs, vector))
        vector = [v / size for v in vector]
    return high, abs(vector[0]) / math.sqrt(sum(v * v for v in vector))


def second_eigenvalue(edges: DataFrame, components: DataFrame, tolerance: float = 1e-10, max_steps: int = 300) -> DataFrame:
    """(item, side, lambda2) of every graph of ``components``; 0 when it is not connected. Raises if one does not settle."""
    n = edges.groupBy(*G).agg(F.countDistinct("chk").alias("checks"), F.countDistinct("qub").alias("qubits"))
    sizes = scratch.table(components.select(*G, "n_components").join(n, G, "left"), "spectrum-graphs")
    # A star's other eigenvalues are all one; a single edge has none but zero and two.
    plain = F.when(F.col("n_components") != 1, 0.0).when(F.greatest("checks", "qubits") == 1, 2.0).when(F.least("checks", "qubits") == 1, 1.0)
    plain = F.when(F.col("checks").isNull(), 0.0).otherwise(plain)
    done = [sizes.withColumn("lambda2", plain).filter("lambda2 is not null").select(*G, "lambda2")]
    open_ = sizes.filter(plain.isNull()).select(*G)
    e = edges.join(open_, G, "left_semi").select(*G, "chk", "qub").distinct()
    dc, dq = (e.groupBy(*G, c).agg(F.count(F.lit(1)).alias(d)) for c, d in (("chk", "dc"), ("qub", "dq")))
    e = scratch.table(e.join(dc, [*G, "chk"]).join(dq, [*G, "qub"]).withColumn("w", 1.0 / F.sqrt(F.col("dc") * F.col("dq"))), "spectrum-edges")
    total = e.groupBy(*G).agg(F.count(F.lit(1)).alias("n_edges"))
    zero = F.lit(0.0)
    # The start: any vector with a part along the wanted one, which a hash of the vertex has.
    state = dc.join(total, G).select(*G, "chk", F.sqrt(F.col("dc") / F.col("n_edges")).alias("u"), rng.random_unit("start", F.col("chk")).alias("y"),
                                     zero.alias("v"), zero.alias("p"))
    state = scratch.table(state, "spectrum-vectors")
    known = state.select(*G).distinct().select(*G, F.array().cast("array<double>").alias("alphas"), F.array().cast("array<double>").alias("betas"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [largest(a, b[1:-1]) for a, b in zip(batch["alphas"], batch["betas"])]
            bound = [last * b[-1] if b[-1] > _CLOSED else 0.0 for (_, last), b in zip(found, batch["betas"])]
            yield batch.assign(theta=[t for t, _ in found], bound=bound)

    for step in range(max_steps + 1):
        # y holds what the operator made of v; the next vector is y without its parts along v, the one before, and u.
        dots = state.groupBy(*G).agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("yv", "yu", "vu", "pu", "yy", "vv", "pp", "yp", "vp")])
        last = F.coalesce(F.get("betas", F.size("betas") - 1), zero)
        coefficients = known.join(dots, G).select(*G, "alphas", "betas", F.col("yv").alias("alpha"), last.alias("beta"), *[c for c in dots.columns if c not in G])
        a, b = F.col("alpha"), F.col("beta")
        gamma = F.col("yu") - a * F.col("vu") - b * F.col("pu")
        coefficients = coefficients.withColumn("gamma", gamma)
        g = F.col("gamma")
        # |y - a v - b p - g u|^2 with u a unit vector and g its whole part along u.
        square = (F.col("yy") + a * a * F.col("vv") + b * b * F.col("pp") - 2 * a * F.col("yv") - 2 * b * F.col("yp") + 2 * a * b * F.col("vp") - g * g)
        coefficients = coefficients.withColumn("next", F.sqrt(F.greatest(square, zero)))
        grown = F.when(F.lit(step) > 0, F.concat("alphas", F.array("alpha"))).otherwise(F.col("alphas"))
        coefficients = scratch.table(coefficients.select(*G, "alpha", "beta", "gamma", "next", grown.alias("alphas"), F.concat("betas", F.array("next")).alias("betas")),
                                     "spectrum-coefficients")
        known = coefficients.select(*G, "alphas", "betas")
        if step:
            judged = scratch.table(known.mapInPandas(settle, f"{', '.join(f'{c} string' for c in G)}, alphas array<double>, betas array<double>, theta double, bound double"),
                                   "spectrum-settled")
            good = F.col("bound") <= tolerance
            done.append(judged.filter(good).select(*G, (F.lit(1.0) - F.sqrt(F.greatest("theta", zero))).alias("lambda2")))
            known = judged.filter(~good).select(*G, "alphas", "betas")
        if known.isEmpty():
            out = done[0]
            for part in done[1:]:
                out = out.unionByName(part)
            return out
        here = coefficients.select(*G, "alpha", "beta", "gamma", "next").join(known.select(*G), G, "left_semi")
        fresh = (F.col("y") - F.col("alpha") * F.col("v") - F.col("beta") * F.col("p") - F.col("gamma") * F.col("u")) / F.col("next")
        vectors = scratch.table(state.join(here, G).select(*G, "chk", "u", fresh.alias("v"), F.col("v").alias("p")), "spectrum-vectors")
        down = e.join(vectors.select(*G, "chk", "v"), [*G, "chk"]).groupBy(*G, "qub").agg(F.sum(F.col("w") * F.col("v")).alias("z"))
        up = e.join(down, [*G, "qub"]).groupBy(*G, "chk").agg(F.sum(F.col("w") * F.col("z")).alias("y"))
        state = scratch.table(vectors.join(up, [*G, "chk"]), "spectrum-vectors")
    raise RuntimeError(f"the second eigenvalue of some graphs did not settle in {max_steps} steps")
