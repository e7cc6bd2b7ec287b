"""Brute-force DuckDB SQL for the same results (the correctness oracle).

The oracle deliberately uses the naive formulations (plain window ranks over
whole groups, mid-rank AUC, row-level joins) so it checks the two-phase
Spark plans rather than restating them. Fragments are named CTEs; ``with_``
assembles the ones a query needs, dependencies first.
"""

from __future__ import annotations

from stratarisk import config as C
from stratarisk.plans import fixtures as FX


def _strata_values() -> str:
    rows = ", ".join(f"('{n}', {s}, {g}, {lo}, {hi}, {i + 1})"
                     for i, (n, s, g, lo, hi) in enumerate(C.STRATA))
    return (f"select * from (values {rows}) "
            f"as t(stratum, sex, age_group, age_min, age_max, stratum_order)")


def _algo_values() -> str:
    rows = ", ".join(f"('{a}', {k})" for a, k, _ in FX.STANDIN_SCORERS)
    return f"select * from (values {rows}) as t(algo, algo_order)"


def hash_sql(id_expr: str, tag: str, seed: int = C.SEED) -> str:
    return (f"cast(('0x' || substr(md5(cast({id_expr} as varchar) || ':{tag}:{seed}'), 1, 8))"
            f"::ubigint as bigint)")


def uniform_sql(*parts: str) -> str:
    key = " || ':' || ".join(parts)
    return (f"((cast(('0x' || substr(md5({key}), 1, 8))::ubigint as bigint) + 1)"
            f" / 4294967297.0)")


def r4(x: str, digits: int = 4) -> str:
    s = f"{10 ** digits}.0"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def judge_sql(val: str, metric: str) -> str:
    g, w, lb = {m: (g, w, lb) for m, g, w, lb, _ in C.THRESHOLDS}[metric]
    op = "<=" if lb else ">="
    return (f"(case when ({val}) is null then null when ({val}) {op} {g} then 'good' "
            f"when ({val}) {op} {w} then 'caution' else 'risk' end)")


def _raw_select(bad_age: bool = False) -> str:
    cols = []
    for name, expr in FX.RAW_SQL_COLUMNS:
        if name == "age" and bad_age:
            expr = FX.BAD_AGE_SQL
        cols.append(f"{expr} as {name}")
    return "select " + ", ".join(cols) + " from orders join customer on o_custkey = c_custkey"


_BAND = "case when {a} <= 39 then 0 when {a} <= 59 then 1 when {a} is not null then 2 end"

CTE = {
    "raw": ([], _raw_select()),
    "raw_bad": ([], _raw_select(bad_age=True)),
    "strata": ([], _strata_values()),
    "algos": ([], _algo_values()),
    "cohort": (["raw"], f"""
        select id, year, sex, try_cast(age as double) as age,
          {_BAND.format(a='try_cast(age as double)')} as age_group,
          cast(case dm_code when 1 then 0 when 3 then 1 end as int) as "Diabetes",
          cast(case hp_code when 1 then 0 when 4 then 1 end as int) as "Hypertension",
          coalesce(try_cast(num_a as double), 0.0) as num_a,
          coalesce(try_cast(num_b as double), 0.0) as num_b,
          coalesce(try_cast(cat_a as double), 0.0) as cat_a
        from raw
        where dm_code in (1, 3) and hp_code in (1, 4) and try_cast(age as double) >= 19"""),
    "scohort": (["cohort", "strata"], """
        select c.*, s.stratum, s.stratum_order
        from cohort c join strata s on c.sex = s.sex and c.age_group = s.age_group"""),
    "cells": (["scohort"], """
        select id, stratum, stratum_order, 'Diabetes' as outcome, "Diabetes" as y, year,
               num_a, num_b, cat_a, age from scohort
        union all
        select id, stratum, stratum_order, 'Hypertension' as outcome, "Hypertension" as y, year,
               num_a, num_b, cat_a, age from scohort"""),
    "ranked": (["cells"], f"""
        select *, row_number() over (partition by stratum, outcome, y
                                     order by {hash_sql('id', 'split')}, id) as rk,
               count(*) over (partition by stratum, outcome, y) as gn
        from cells"""),
    "split": (["ranked"], f"""
        select id, stratum, stratum_order, outcome, y, year, num_a, num_b, cat_a, age,
               rk <= floor({C.TEST_FRACTION} * gn + 0.5) as is_test,
               cast((rk - 1) % {C.N_FOLDS} as int) as fold
        from ranked"""),
    "scored": (["split", "algos"], "select s.id as row_id, s.stratum, s.stratum_order, s.outcome, "
               "a.algo, a.algo_order, s.y, case a.algo "
               + " ".join(f"when '{a}' then {FX.p6_sql(lg)}" for a, _, lg in FX.STANDIN_SCORERS)
               + " end as p6, s.is_test, s.fold, s.year, s.num_a, s.num_b, s.cat_a, s.age "
               "from split s cross join algos a"),
    "dscored": (["split", "algos"], "select s.id as row_id, s.stratum, s.outcome, a.algo, s.y, case a.algo "
                + " ".join(f"when '{a}' then {FX.soft_sql(lg)}" for a, _, lg in FX.STANDIN_SCORERS)
                + " end as p, s.is_test, s.fold from split s cross join algos a"),
}


def with_(*names: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """WITH clause holding ``names`` and their dependencies, in dependency order."""
    table = dict(CTE)
    if extra:
        table.update(extra)
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in table[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({table[n][1]})" for n in order) + "\n"


# ---- metric fragments (brute force) ----------------------------------------

def auc_sql(src: str, keys: list[str]) -> str:
    """Mid-rank (Mann-Whitney) AUC per group, exact integer numerator."""
    k = ", ".join(keys)
    return f"""(select {k}, cast(count(*) as bigint) as n, cast(sum(y) as bigint) as n_pos,
        cast(count(*) - sum(y) as bigint) as n_neg,
        case when sum(y) > 0 and count(*) - sum(y) > 0 then
          cast(sum(case when y = 1 then 2 * r + ties - 1 else 0 end) - sum(y) * (sum(y) + 1) as double)
          / (2.0 * cast(sum(y) as double) * cast(count(*) - sum(y) as double)) end as auc
      from (select {k}, y, rank() over (partition by {k} order by p6) as r,
                   count(*) over (partition by {k}, p6) as ties from {src}) z
      group by {k})"""


def _ratio(n: str, d: str) -> str:
    return f"(case when ({d}) > 0 then cast({n} as double) / ({d}) else 0.0 end)"


def conf_sql(src: str, keys: list[str], t6: int = 500000) -> str:
    k = ", ".join(keys)
    return f"""(select {k}, tp, fp, fn, tn, {_ratio('tp', 'tp + fn')} as tpr, {_ratio('fp', 'fp + tn')} as fpr
      from (select {k},
        cast(count_if(y = 1 and p6 >= {t6}) as bigint) as tp,
        cast(count_if(y = 0 and p6 >= {t6}) as bigint) as fp,
        cast(count_if(y = 1 and p6 < {t6}) as bigint) as fn,
        cast(count_if(y = 0 and p6 < {t6}) as bigint) as tn
      from {src} group by {k}) z)"""


def _f1(p: str, r: str) -> str:
    return f"(case when {p} + {r} > 0 then 2.0 * {p} * {r} / ({p} + {r}) else 0.0 end)"


def prf_sql(conf: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    p1, r1 = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
    p0, r0 = _ratio("tn", "tn + fn"), _ratio("tn", "tn + fp")
    s1, s0 = "cast(tp + fn as double)", "cast(tn + fp as double)"
    n = f"({s0} + {s1})"

    def wavg(m0, m1):
        return f"(({s0} * {m0} + {s1} * {m1}) / {n})"

    return f"""(select {k}, tp + fp + fn + tn as n, {wavg(p0, p1)} as precision,
        {wavg(r0, r1)} as recall, {wavg(_f1(p0, r0), _f1(p1, r1))} as f1 from {conf} z)"""


def bins_sql(src: str, keys: list[str], n_bins: int = 10) -> str:
    k = ", ".join(keys)
    return f"""(select {k}, bin, cast(count(*) as bigint) as n, cast(sum(y) as bigint) as sum_y,
        cast(sum(p6) as bigint) as sum_p6, cast(sum(y) as double) / count(*) as mean_y,
        cast(sum(p6) as double) / (1e6 * count(*)) as mean_p
      from (select *, cast(floor((cast(p6 as bigint) * {n_bins} + 999999) / 1e6) as int) as bin from {src}) z
      where bin > 0 group by {k}, bin)"""


def ece_sql(src: str, keys: list[str], n_bins: int = 10) -> str:
    k = ", ".join(keys)
    on = " and ".join(f"a.{c} = b.{c}" for c in keys)
    ka = ", ".join(f"a.{c}" for c in keys)
    return f"""(select {ka}, a.n, cast(coalesce(b.g, 0) as double) / (1e6 * a.n) as ece
      from (select {k}, cast(count(*) as bigint) as n from {src} group by {k}) a
      left join (select {k}, sum(abs(sum_y * 1000000 - sum_p6)) as g from {bins_sql(src, keys, n_bins)} bb
                 group by {k}) b on {on})"""


# ---- the same on unrounded double scores ``p`` ------------------------------

def exact_auc_sql(src: str, keys: list[str]) -> str:
    return auc_sql(f"(select *, p as p6 from {src}) q", keys)


def exact_conf_sql(src: str, keys: list[str]) -> str:
    return conf_sql(f"(select *, case when p >= 0.5::double then 1 else 0 end as p6 from {src}) q", keys, t6=1)


def exact_bins_sql(src: str, keys: list[str], n_bins: int = 10) -> str:
    """Bins of (lo, hi]; scores summed in units of 2^-53."""
    k = ", ".join(keys)
    edges = " + ".join(f"cast(p > {i * (1.0 / n_bins)!r}::double as int)" for i in range(1, n_bins))
    return f"""(select {k}, bin, cast(count(*) as bigint) as n, cast(sum(y) as bigint) as sum_y,
        sum(cast(floor(p * 9007199254740992.0::double) as hugeint)) as sum_u
      from (select *, cast(case when p > 0 and p <= 1 then 1 + {edges} else 0 end as int) as bin from {src}) z
      group by {k}, bin)"""


def exact_ece_sql(src: str, keys: list[str], n_bins: int = 10) -> str:
    k = ", ".join(keys)
    gap = "sum(case when bin > 0 then abs(sum_y::hugeint * 9007199254740992::hugeint - sum_u) else 0 end)"
    return f"""(select {k}, cast(sum(n) as bigint) as n,
        cast(cast({gap} as varchar) as double) / (9007199254740992.0::double * cast(sum(n) as bigint)) as ece
      from {exact_bins_sql(src, keys, n_bins)} b group by {k})"""
