"""Normal distribution functions as SQL expression text.

Neither Spark SQL nor DuckDB has ``erf`` or an inverse normal CDF.  These
generators return plain SQL arithmetic (``exp``, ``ln``, ``sqrt``, ``abs``,
``CASE``) that runs verbatim in both dialects, so the Spark path stays inside
codegen (``F.expr``) and the DuckDB oracles use the identical formula.

Pass a simple column reference as the argument: it is repeated in the text.
"""

from __future__ import annotations

import math

# Wichura (1988), Applied Statistics algorithm AS 241 (PPND16).
AS241_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
           1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
           3.3430575583588128105e4, 2.5090809287301226727e3]
AS241_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
           5.2264952788528545610e3]
AS241_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
           3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
           2.27238449892691845833e-2, 7.74545014278341407640e-4]
AS241_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
           1.05075007164441684324e-9]
AS241_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
           2.04426310338993978564e-15]

# Hart (1968) algorithm 5666 for the normal tail, in the double
# precision form published by West (2005); ascending powers of |x|.
HART_P = [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
          6.37396220353165, 0.700383064443688, 3.52624965998911e-02]
HART_Q = [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
          86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-02]
HART_SWITCH = 7.07106781186547
HART_CUTOFF = 37.0

SQRT_2PI = 2.5066282746310002


def _poly(coefs: list[float], x: str) -> str:
    """Horner form of sum(coefs[i] * x**i)."""
    expr = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        expr = f"({expr} * {x} + {c!r})"
    return expr


def norm_ppf_sql(p: str, q: str | None = None, r1: str | None = None,
                 rt: str | None = None) -> str:
    """Inverse standard normal CDF (AS 241, ~1e-16 relative); NULL outside (0, 1).

    ``q``, ``r1`` and ``rt`` may name precomputed columns holding ``p - 0.5``,
    ``0.180625 - q^2`` and ``sqrt(-ln(min(p, 1 - p)))``; this keeps the
    expression tree small (see ``ppf_stages``)."""
    q = q or f"({p} - 0.5)"
    r1 = r1 or f"(0.180625 - {q} * {q})"
    central = f"({q} * {_poly(AS241_A, r1)} / {_poly(AS241_B, r1)})"
    rt = rt or f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1.0 - {p} END))"
    r2 = f"({rt} - 1.6)"
    r3 = f"({rt} - 5.0)"
    tail_mid = f"({_poly(AS241_C, r2)} / {_poly(AS241_D, r2)})"
    tail_far = f"({_poly(AS241_E, r3)} / {_poly(AS241_F, r3)})"
    tail = f"(CASE WHEN {rt} <= 5.0 THEN {tail_mid} ELSE {tail_far} END)"
    return (f"(CASE WHEN {p} <= 0.0 OR {p} >= 1.0 THEN NULL "
            f"WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


def ppf_stages(df, p: str, out: str):
    """Spark helper: add ``out = Phi^-1(p)`` through staged helper columns."""
    from pyspark.sql import functions as F

    q, r1, rt = f"_{out}_q", f"_{out}_r1", f"_{out}_rt"
    pc = F.col(p)
    df = (df.withColumn(q, pc - 0.5)
          .withColumn(r1, F.lit(0.180625) - F.col(q) * F.col(q))
          .withColumn(rt, F.sqrt(-F.log(F.when(F.col(q) < 0, pc).otherwise(1.0 - pc)))))
    return df.withColumn(out, F.expr(norm_ppf_sql(p, q, r1, rt))).drop(q, r1, rt)


def norm_cdf_sql(x: str) -> str:
    """Standard normal CDF (Hart 5666, ~1e-16 absolute): a rational function of
    |x| times exp(-x^2/2) below 7.07, Laplace's continued fraction above."""
    a = f"abs({x})"
    e = f"exp(-0.5 * {a} * {a})"
    rational = f"({e} * {_poly(HART_P, a)} / {_poly(HART_Q, a)})"
    frac = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        frac = f"({a} + {k}.0 / {frac})"
    cont = f"({e} / {frac} / {SQRT_2PI!r})"
    tail = (f"(CASE WHEN {a} > {HART_CUTOFF} THEN 0.0 WHEN {a} < {HART_SWITCH} THEN {rational} "
            f"ELSE {cont} END)")
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def ks_stages(z: str, n: str) -> list[tuple[str, str]]:
    """Helper columns ``(name, SQL)`` of the finite-n Kolmogorov distribution at ``z = sqrt(n) * D``
    (Pelz and Good 1976: the limit and its corrections in 1/sqrt(n), 1/n and 1/n^1.5).  The series
    has terms exp(-(pi h / z)^2 / 2): ``ks_a<i>`` weigh h^2i at h = 1/2, 3/2, ... and ``ks_b<i>``
    at h = 1, 2, ...; ``z`` must be positive."""
    c, p2 = SQRT_2PI, math.pi ** 2
    zz = f"({z} * {z})"
    z3, z4 = f"({zz} * {z})", f"({zz} * {zz})"
    z6, z7, z8 = f"({z4} * {zz})", f"({z4} * {z3})", f"({z4} * {z4})"
    z10 = f"({z8} * {zz})"
    r1 = f"({c!r} / 6.0 / {z4} / sqrt({n}))"
    r2 = f"({c!r} / 72.0 / {z7} / {n})"
    r3 = f"({c!r} / 6480.0 / {z10} / ({n} * sqrt({n})))"
    q2 = f"({c!r} / 36.0 / {z3} / {n})"
    q3 = f"({c!r} / 216.0 / {z6} / ({n} * sqrt({n})))"
    return [
        ("ks_a0", f"{c!r} / {z} - {r1} * {zz} + {r2} * (6.0 * {z6} + 2.0 * {z4}) "
                  f"- {r3} * (30.0 * {z6} + 90.0 * {z8})"),
        ("ks_a1", f"{p2!r} * ({r1} + {r2} * (2.0 * {z4} - 5.0 * {zz}) + {r3} * (135.0 * {z4} - 96.0 * {z6}))"),
        ("ks_a2", f"{p2 ** 2!r} * ({r2} * (1.0 - 2.0 * {zz}) + {r3} * (212.0 * {z4} - 60.0 * {zz}))"),
        ("ks_a3", f"{p2 ** 3!r} * {r3} * (5.0 - 30.0 * {zz})"),
        ("ks_b1", f"{p2!r} * (3.0 * {q3} * {zz} - {q2})"),
        ("ks_b2", f"-{p2 ** 2!r} * {q3}"),
    ]


def ks_sf_sql(z: str, terms: int = 16) -> str:
    """Upper tail of D's distribution over the columns of ``ks_stages``, clamped to [0, 1]
    (0 from z = 5 on, where it is below 1e-21)."""
    parts = []
    for k in range(1, terms + 1):
        h2 = (k - 0.5) ** 2
        parts.append(f"exp({-math.pi ** 2 * h2 / 2!r} / ({z} * {z})) * "
                     f"(ks_a0 + {h2!r} * (ks_a1 + {h2!r} * (ks_a2 + {h2!r} * ks_a3)))")
        h2 = float(k * k)
        parts.append(f"exp({-math.pi ** 2 * h2 / 2!r} / ({z} * {z})) * {h2!r} * (ks_b1 + {h2!r} * ks_b2)")
    return (f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 5.0 THEN 0.0 "
            f"ELSE least(greatest(1.0 - ({' + '.join(parts)}), 0.0), 1.0) END)")
