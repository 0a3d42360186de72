"""SQL for an independent engine to check ``statistics.py`` with; {name} stands for a table."""

from __future__ import annotations

#: Thermal values m of each disorder sample s at a grid point (f, t).
VALUES = "select l_returnflag as f, l_linestatus as t, l_orderkey as s, l_linenumber as k, (l_discount - 0.05) / 0.05 as m from {lineitem}"
#: Thermal means by sample.
THERMAL = f"select f, t, s, count(*) as n, avg(m) as m1, avg(abs(m)) as a1, avg(m * m) as m2, avg(m * m * m) as m3, avg(abs(m * m * m)) as a3, avg(m * m * m * m) as m4, max(k) as last from ({VALUES}) v group by f, t, s"
#: Observable P of size L at density rho, by order month.
GRID = "select c_nationkey as l, o_orderpriority as band, cast(floor(o_totalprice / 10000) as bigint) as rho_key, o_totalprice as p from {orders} join {customer} on o_custkey = c_custkey"
POINTS = f"select l, rho_key, count(*) as n, avg(p) as p1, var_pop(p) as v from ({GRID}) g group by l, rho_key"

QUERIES = {
    "moments": f"select f, t, count(*) as n, round(avg(m), 9) as m1, round(avg(abs(m)), 9) as abs1, round(avg(m * m), 9) as m2, round(avg(m * m * m * m), 9) as m4, round(stddev_pop(m), 9) as sd from ({VALUES}) v group by f, t",
    "two_level_average": f"select f, t, count(*) as samples, round(avg(m1), 9) as dis_m, round(avg(a1), 9) as dis_abs, round(avg(m2), 9) as dis_m2, round(avg(m3), 9) as dis_m3, round(avg(a3), 9) as dis_abs3, round(avg(m4), 9) as dis_m4, round(avg(m1 * m1), 9) as q_ea, round(avg(a1 * a1), 9) as dis_abs_sq, round(avg(m1 * m1 * m1 * m1), 9) as dis_m_p4, round(avg(a1 * a1 * a1 * a1), 9) as dis_abs_p4, round(avg(m2 * m2), 9) as dis_m2_sq from ({THERMAL}) s group by f, t",
    "susceptibility": "select f, t, " + ", ".join(f"round(max(last) * avg(m2 - {c} * {c}), 8) as chi_th_{name}, round(max(last) * var_pop({c}), 8) as chi_dis_{name}, round(max(last) * (avg(m2) - avg({c}) * avg({c})), 8) as chi_tot_{name}" for c, name in (("a1", "abs"), ("m1", "m"))) + f" from ({THERMAL}) s group by f, t",
    "binder": "select f, t, " + ", ".join(f"round(case when avg({x}) > 1e-15 then 1 - avg(({x}) * ({x4})) / (3 * avg({x}) * avg({x})) else 0 end, 9) as {name}" for x, x4, name in (("m2", "case when m2 > 0 then m4 / m2 else 0 end", "u4"), ("m1 * m1", "m1 * m1", "u_ea"), ("a1 * a1", "a1 * a1", "u_ea_abs"), ("m2", "m2", "u22"))) + f" from ({THERMAL}) s group by f, t",
    "jackknife_chi": f"""select f, t, count(*) as n, round(coalesce(sqrt(greatest(sum((th - mean) * (th - mean)), 0) * (max(n) - 1) / max(n)), 0), 10) as sem from (
        select f, t, n, th, avg(th) over (partition by f, t) as mean from (
        select f, t, n, (s2 - m2) / nullif(n - 1, 0) - ((s1 - a1) / nullif(n - 1, 0)) * ((s1 - a1) / nullif(n - 1, 0)) as th from (
        select s.f, s.t, a1, m2, n2 as n, s1, s2 from ({THERMAL}) s join (select f, t, count(*) as n2, sum(a1) as s1, sum(m2) as s2 from ({THERMAL}) q group by f, t) z on s.f = z.f and s.t = z.t) j) k) w group by f, t""",
    "peak_rho": f"select l, min(rho_key) as peak from (select l, rho_key, rank() over (partition by l order by round(v, 4) desc) as r from ({POINTS}) p where n > 1) q where r = 1 group by l",
    "nearest_point": f"select l, min(rho_key) as rho_key from (select l, rho_key, rank() over (partition by l order by abs(rho_key - 17)) as r from ({POINTS}) p) q where r = 1 group by l",
    "window_filter": f"select l, rho_key, n, round(p1, 6) as p1 from ({POINTS}) p where rho_key between 10 and 20 and l % 2 = 0",
    "loglog_slope": f"select l, round(coalesce((count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0), 0), 6) as slope from (select l, ln(rho_key + 1) as x, ln(n) as y from ({POINTS}) p) q group by l",
    "fit_quality": f"select l, round(sqrt(avg(r * r)), 6) as rmse, round(case when sum((p - mean) * (p - mean)) > 0 then 1 - sum(r * r) / sum((p - mean) * (p - mean)) end, 9) as r2 from (select l, p, p - (rho_key * 10000 + 5000) as r, avg(p) over (partition by l) as mean from ({GRID}) g) q group by l",
    "sem_from_moments": f"select l, rho_key, round(sqrt(greatest(avg(p * p) - avg(p) * avg(p), 0) / count(*)), 4) as sem from ({GRID}) g group by l, rho_key",
    "step_median": f"select l, median(d) as step from (select l, rho_key - lag(rho_key) over (partition by l order by rho_key) as d from ({POINTS}) p) q where d is not null group by l",
    "collapse_frame": f"select l, rho_key, round((rho_key - 17.0) * power((l + 1) / 25.0, 1.25), 8) as x, round(p1 * power((l + 1) / 25.0, 0.125), 4) as y from ({POINTS}) p",
    "resume_antijoin": "select o_orderkey, o_custkey from {orders} where not exists (select 1 from {events} where user_id = o_custkey)",
    "histogram_nonzero": "select n as size, count(*) as how_many from (select l_orderkey, count(*) as n from {lineitem} group by l_orderkey) q group by n",
    "type_counts": "select l_returnflag as f, sum(case when l_linestatus = 'O' and l_linenumber % 2 = 0 then 1 else 0 end) as o_even, sum(case when l_linestatus = 'O' and l_linenumber % 2 = 1 then 1 else 0 end) as o_odd, sum(case when l_linestatus = 'F' and l_linenumber % 2 = 0 then 1 else 0 end) as f_even, sum(case when l_linestatus = 'F' and l_linenumber % 2 = 1 then 1 else 0 end) as f_odd from {lineitem} group by l_returnflag",
    "ratio_stats": "select s_nationkey as nation, round(avg(q), 9) as mean, round(coalesce(stddev_samp(q), 0), 9) as sd1, round(stddev_pop(q), 9) as sd0 from (select l_suppkey, avg(cast(case when l_returnflag = 'R' then 1 else 0 end as double)) as q from {lineitem} group by l_suppkey) r join {supplier} on l_suppkey = s_suppkey group by s_nationkey",
    "overlap_popcount": "select a.s, bit_count(a.bits & b.bits) as both_set, bit_count(b.bits) as of_b, round(case when b.bits = 0 then 0.0 else bit_count(a.bits & b.bits) * 1.0 / bit_count(b.bits) end, 9) as overlap from (select l_orderkey as s, bit_or(case when l_returnflag = 'N' then cast(power(2, l_linenumber) as bigint) else 0 end) as bits from {lineitem} group by l_orderkey) a join (select l_orderkey as s, bit_or(case when l_linestatus = 'O' then cast(power(2, l_linenumber) as bigint) else 0 end) as bits from {lineitem} group by l_orderkey) b on a.s = b.s",
    "asof_tolerance": "select event_id, min(o_orderkey) as o_orderkey, min(gap) as gap from (select event_id, o_orderkey, abs(cast(floor(value * 1000) as bigint) - cast(floor(o_totalprice) as bigint)) as gap, rank() over (partition by event_id order by abs(cast(floor(value * 1000) as bigint) - cast(floor(o_totalprice) as bigint))) as r from {events} join {orders} on user_id = o_custkey) q where r = 1 and gap <= 5000 group by event_id",
}
