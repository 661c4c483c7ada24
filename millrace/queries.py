"""The engine's own queries over the driver's tables: each in the language, and in SQL for comparison.

LANGUAGE maps a name to the query's text and its SQL; the SQL is None where it cannot say the same.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, Options

TABLES = "region nation customer supplier part orders lineitem events".split()

# Prices that are null for small parts: the tables hold no nulls of their own.
_SIZE = "case when p_size > 25 then p_size end"
_BRAND = "case when p_size > 25 then p_brand end"

LANGUAGE: dict[str, tuple[str, str | None]] = {
    # sources and projection
    "scan_select_all": ("select * from nation", "select * from nation"),
    "scan_bare_file": ("region", "select * from region"),
    "scan_comments": ("-- rows\nselect r_name /* only */ from region", "select r_name from region"),
    "project_arith": ("select l_orderkey, l_linenumber, l_extendedprice * l_discount as disc, l_quantity + l_linenumber as qn from lineitem", "select l_orderkey, l_linenumber, l_extendedprice * l_discount as disc, l_quantity + l_linenumber as qn from lineitem"),
    "project_optional_commas": ("M select n_name n_regionkey * 2 as r2 from nation", "select n_name, (n_regionkey * 2)::bigint as r2 from nation"),
    "project_alias_forms": ("select a = r_name, r_regionkey b, r_regionkey + 1 as c from region", "select r_name as a, r_regionkey as b, (r_regionkey + 1)::bigint as c from region"),
    "project_by_position": ("select c1 + 0 as k, nation.c2 as name from nation", "select n_nationkey::bigint as k, n_name as name from nation"),
    "right_assoc_arith": ("select o_orderkey, o_custkey - o_orderkey - 7 as a, 1000000 / 7 / 2 as b, o_custkey * 3 % 5 as c from orders", "select o_orderkey, o_custkey - (o_orderkey - 7) as a, 333333::bigint as b, o_custkey * (3 % 5) as c from orders"),
    "int_div_trunc": ("select s_suppkey, s_suppkey / 7 as q, (0 - s_suppkey) / 7 as nq from supplier", "select s_suppkey, s_suppkey // 7 as q, (0 - s_suppkey) // 7 as nq from supplier"),
    "div_by_zero_null": (
        "select p_partkey, p_size / (p_size % 2) as a, p_retailprice / (p_size % 2) as b, p_size % (p_size % 3) as c from part",
        "select p_partkey, (p_size // nullif(p_size % 2, 0))::bigint as a, p_retailprice / nullif(p_size % 2, 0) as b, (p_size % nullif(p_size % 3, 0))::bigint as c from part",
    ),
    "modulo": ("select s_suppkey, (0 - s_suppkey) % 7 as r, s_acctbal % 7.5 as f from supplier", "select s_suppkey, (0 - s_suppkey) % 7 as r, s_acctbal % 7.5::double as f from supplier"),
    "power": ("select p_partkey, p_size ^ 2 as sq, p_size * 2 ^ 2 as m, pow(p_size, 0.5) as rt from part", "select p_partkey, (p_size * p_size)::bigint as sq, (p_size * 4)::bigint as m, pow(p_size, 0.5) as rt from part"),
    "unary_neg": ("select c_custkey, -c_acctbal as neg, 5 + -c_nationkey as n from customer", "select c_custkey, -c_acctbal as neg, (5 - c_nationkey)::bigint as n from customer"),
    "string_concat_null": (f"select p_partkey, {_BRAND} + '/' + p_type as t, {_BRAND} + {_BRAND} as bb from part", f"select p_partkey, coalesce({_BRAND}, '') || '/' || p_type as t, {_BRAND} || {_BRAND} as bb from part"),
    "number_meets_text": ("select n_nationkey + n_name as kn, n_nationkey + '5' as k5 from nation", "select n_nationkey::varchar || n_name as kn, (n_nationkey + 5)::bigint as k5 from nation"),
    "case_pred": (
        "select p_partkey, case when p_size < 10 then 'small' when p_size between 10 and 30 then 'mid' else 'large' end as size_class from part",
        "select p_partkey, case when p_size < 10 then 'small' when p_size between 10 and 30 then 'mid' else 'large' end as size_class from part",
    ),
    "case_expr": ("select o_orderkey, case o_orderstatus when 'O' then 1 when 'F' then 2 end as code from orders", "select o_orderkey, (case o_orderstatus when 'O' then 1 when 'F' then 2 end)::bigint as code from orders"),
    "alias_vars": (
        "with l_extendedprice * (1 - l_discount) as net, net * (1 + l_tax) as gross select l_orderkey, net, gross from lineitem where net > 90000",
        "select l_orderkey, l_extendedprice * (1 - l_discount) as net, l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross from lineitem where l_extendedprice * (1 - l_discount) > 90000",
    ),
    "alias_promoted": ("select o_totalprice / 1000 as k, o_orderkey from orders where k < 5", "select o_totalprice / 1000 as k, o_orderkey from orders where o_totalprice / 1000 < 5"),
    # predicates
    "filter_eq": ("select o_orderkey from orders where o_orderstatus = F", "select o_orderkey from orders where o_orderstatus = 'F'"),
    "filter_eq_null": (f"select p_partkey from part where {_BRAND} = null", "select p_partkey from part where p_size <= 25"),
    "filter_ne_null": (f"select p_partkey from part where {_BRAND} <> 'Brand#11'", f"select p_partkey from part where {_BRAND} is distinct from 'Brand#11'"),
    "filter_range": (
        f"select p_partkey, p_size from part where {_SIZE} > 40 and p_retailprice <= 1500",
        "select p_partkey, p_size from part where (p_size <= 25 or p_size > 40) and p_retailprice <= 1500",
    ),
    "filter_less_null": (f"select p_partkey from part where {_SIZE} < 40", "select p_partkey from part where p_size > 25 and p_size < 40"),
    "filter_between_symmetric": ("select l_orderkey, l_quantity from lineitem where l_quantity between 10 and 5", "select l_orderkey, l_quantity from lineitem where l_quantity between 5 and 10"),
    "filter_not_between_null": (f"select p_partkey from part where {_SIZE} not between 30 and 40", "select p_partkey from part where p_size > 25 and p_size not between 30 and 40"),
    "filter_between_dates": ("select o_orderkey from orders where o_orderdate between '1/1/1997' and '1996-06-01'", "select o_orderkey from orders where o_orderdate between timestamp '1996-06-01' and timestamp '1997-01-01'"),
    "filter_like_ci": ("select p_partkey, p_name from part where p_name like 'RED%' or p_type like '_mall'", "select p_partkey, p_name from part where p_name ilike 'red%' or p_type ilike '_mall'"),
    "filter_not_like_null": (f"select p_partkey from part where {_BRAND} not like 'brand#1%'", f"select p_partkey from part where coalesce({_BRAND}, '') not ilike 'brand#1%'"),
    "filter_in_list": ("select c_custkey from customer where c_mktsegment in (BUILDING, MACHINERY)", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "filter_in_list_expr": ("select p_partkey from part where p_size in (p_partkey % 50, 7)", "select p_partkey from part where p_size in (p_partkey % 50, 7)"),
    "filter_not_in_list": (f"select p_partkey from part where {_BRAND} not in ('Brand#1', 'Brand#2')", f"select p_partkey from part where coalesce({_BRAND}, '') not in ('Brand#1', 'Brand#2')"),
    "filter_xor": ("select l_orderkey, l_linenumber from lineitem where l_quantity > 25 xor l_discount > 0.05", "select l_orderkey, l_linenumber from lineitem where (l_quantity > 25) <> (l_discount > 0.05)"),
    "filter_right_assoc_logic": ("select p_partkey from part where p_size > 40 and p_partkey > 100 or p_type = SMALL", "select p_partkey from part where p_size > 40 and (p_partkey > 100 or p_type = 'SMALL')"),
    "filter_not_chain": ("select p_partkey from part where not p_size > 40 and p_partkey > 100", "select p_partkey from part where not (p_size > 40 and p_partkey > 100)"),
    "filter_not_parens": ("select p_partkey from part where !(p_size > 40 or p_size < 5)", "select p_partkey from part where not (p_size > 40 or p_size < 5)"),
    "filter_is_null": (f"select p_partkey from part where {_SIZE} is null or {_SIZE} is not null and p_size > 45", "select p_partkey from part where p_size <= 25 or p_size > 45"),
    # joins
    "join_inner": ("select c.c_name, o.o_orderkey, o.o_totalprice from orders o join customer c on o.o_custkey = c.c_custkey", "select c_name, o_orderkey, o_totalprice from orders join customer on o_custkey = c_custkey"),
    "join_left": (
        "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 400000",
        "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 400000",
    ),
    "join_three_way": (
        "select c.c_mktsegment, l.l_returnflag, sum(l.l_quantity) as q from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey group by c.c_mktsegment, l.l_returnflag",
        "select c_mktsegment, l_returnflag, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2",
    ),
    "join_vars": (
        "with s.s_nationkey as a, n.n_nationkey as b, n.n_name as country select s.s_name, country from supplier s join nation n on a = b where country like '%1'",
        "select s_name, n_name as country from supplier join nation on s_nationkey = n_nationkey where n_name like '%1'",
    ),
    "join_expression_key": ("select n.n_name, r.r_name from nation n join region r on n.n_nationkey % 5 = r.r_regionkey", "select n_name, r_name from nation join region on n_nationkey % 5 = r_regionkey"),
    "join_range": ("select s.s_suppkey, n.n_nationkey from supplier s join nation n on n.n_nationkey < s.s_nationkey", "select s_suppkey, n_nationkey from supplier join nation on n_nationkey < s_nationkey"),
    "join_range_greater": ("select s.s_suppkey, n.n_nationkey from supplier s join nation n on n.n_nationkey >= s.s_nationkey", "select s_suppkey, n_nationkey from supplier join nation on n_nationkey >= s_nationkey"),
    "join_or": (
        "select o.o_orderkey, c.c_custkey from orders o join customer c on o.o_custkey = c.c_custkey or o.o_orderkey = c.c_custkey",
        "select o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey or o_orderkey = c_custkey",
    ),
    "join_or_left": (
        "select o.o_orderkey, s.s_suppkey from orders o left join supplier s on o.o_custkey = s.s_suppkey or o.o_orderkey = s.s_suppkey",
        "select o_orderkey, s_suppkey from orders left join supplier on o_custkey = s_suppkey or o_orderkey = s_suppkey",
    ),
    "join_xor": (
        "select o.o_orderkey, c.c_custkey from orders o join customer c on o.o_custkey = c.c_custkey xor o.o_orderkey = c.c_custkey",
        "select o_orderkey, c_custkey from orders join customer on (o_custkey = c_custkey) <> (o_orderkey = c_custkey)",
    ),
    "join_and_residual": (
        "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey and c.c_mktsegment like 'b%' and c.c_nationkey <> 3 and o.o_totalprice > c.c_acctbal",
        "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey and c_mktsegment ilike 'b%' and c_nationkey <> 3 and o_totalprice > c_acctbal",
    ),
    "semi_in_subquery": ("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 1000)", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 1000)"),
    "anti_not_in_subquery": ("select c_custkey from customer where c_custkey not in (select o_custkey from orders)", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)"),
    "in_subquery_or": (
        "select c_custkey from customer where c_nationkey = 3 or c_custkey in (select o_custkey from orders where o_totalprice > 450000)",
        "select c_custkey from customer where c_nationkey = 3 or c_custkey in (select o_custkey from orders where o_totalprice > 450000)",
    ),
    "in_subquery_columns": ("select s_suppkey from supplier where s_suppkey in (select n_nationkey, n_regionkey + 50 from nation)", "select s_suppkey from supplier where s_suppkey in (select n_nationkey from nation union all select n_regionkey + 50 from nation)"),
    "in_agg_subquery": ("select c_name from customer where c_custkey in (select max(o_custkey) from orders group by o_orderpriority)", "select c_name from customer where c_custkey in (select max(o_custkey) from orders group by o_orderpriority)"),
    "having_in_subquery": (
        "select n_regionkey, max(n_nationkey) as m from nation group by n_regionkey having max(n_nationkey) in (select s_nationkey from supplier)",
        "select n_regionkey, max(n_nationkey)::bigint as m from nation group by n_regionkey having max(n_nationkey) in (select s_nationkey from supplier)",
    ),
    # aggregation
    "agg_group": (
        "select l_returnflag, sum(l_quantity) as q, count(*) as n from lineitem where l_discount between 0.05 and 0.07 group by l_returnflag",
        "select l_returnflag, sum(l_quantity) as q, count(*)::double as n from lineitem where l_discount between 0.05 and 0.07 group by l_returnflag",
    ),
    "agg_multi_key": (
        "select l_returnflag, l_linestatus, sum(l_quantity) as q, round(avg(l_extendedprice), 2) as p, count(*) as n from lineitem group by l_returnflag, l_linestatus",
        "select l_returnflag, l_linestatus, sum(l_quantity) as q, round(avg(l_extendedprice), 2) as p, count(*)::double as n from lineitem group by 1, 2",
    ),
    "agg_group_expr": ("select o_custkey % 10 as k, count(*) as n from orders group by k", "select o_custkey % 10 as k, count(*)::double as n from orders group by 1"),
    "agg_global": ("select count(*) as n, sum(l_linenumber) as s, avg(l_quantity) as a, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem", "select count(*)::double as n, sum(l_linenumber)::bigint as s, avg(l_quantity) as a, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem"),
    "agg_global_empty": ("select count(*) as n, sum(l_quantity) as q, max(l_returnflag) as f from lineitem where l_quantity < 0", "select count(*)::double as n, sum(l_quantity) as q, max(l_returnflag) as f from lineitem where l_quantity < 0"),
    "agg_int_division": ("select sum(c_nationkey) / 7 as q, count(*) / 7 as f from customer", "select (sum(c_nationkey) // 7)::bigint as q, count(*) / 7.0::double as f from customer"),
    "agg_stdev_samp": ("select o_orderstatus, round(stdev(o_totalprice), 2) as s from orders group by o_orderstatus", "select o_orderstatus, round(stddev_samp(o_totalprice), 2) as s from orders group by 1"),
    "agg_stdev_single": ("select n_nationkey, stdev(n_regionkey) as s, stdevp(n_regionkey) as p from nation group by n_nationkey", "select n_nationkey, null::double as s, null::double as p from nation"),
    "agg_stdev_pop": ("select o_orderstatus, round(stdevp(o_totalprice), 2) as s from orders group by o_orderstatus", "select o_orderstatus, round(stddev_pop(o_totalprice), 2) as s from orders group by 1"),
    "agg_min_max_text": ("select p_brand, min(p_name) as lo, max(p_type) as hi from part group by p_brand", "select p_brand, min(p_name) as lo, max(p_type) as hi from part group by 1"),
    "agg_count_col": (f"select p_type, count({_BRAND}) as n, count(*) as a from part group by p_type", f"select p_type, count({_BRAND})::double as n, count(*)::double as a from part group by 1"),
    "agg_count_distinct": ("select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag", "select l_returnflag, count(distinct l_suppkey)::double as n from lineitem group by 1"),
    "agg_sum_distinct": ("select l_linestatus, sum(distinct l_quantity) as s, avg(distinct l_linenumber) as a from lineitem group by l_linestatus", "select l_linestatus, sum(distinct l_quantity) as s, avg(distinct l_linenumber) as a from lineitem group by 1"),
    "agg_stdev_distinct": ("select p_type, round(stdev(distinct p_size), 6) as s from part group by p_type", "select p_type, round(stddev_samp(p_size), 6) as s from (select distinct p_type, p_size from part) group by 1"),
    "agg_first_nonnull": (
        "select n.n_name, r.r_name, count(*) as k from nation n join region r on n.n_regionkey = r.r_regionkey group by n.n_name",
        "select n_name, any_value(r_name) as r_name, count(*)::double as k from nation join region on n_regionkey = r_regionkey group by 1",
    ),
    "agg_last_expr": (
        "select n.n_name, r.r_name + '!' as last, count(*) as k from nation n join region r on n.n_regionkey = r.r_regionkey group by n.n_name",
        "select n_name, any_value(r_name) || '!' as last, count(*)::double as k from nation join region on n_regionkey = r_regionkey group by 1",
    ),
    "agg_having": ("select c_mktsegment, count(*) as n from customer group by c_mktsegment having count(*) > 10 and max(c_acctbal) > 5000", "select c_mktsegment, count(*)::double as n from customer group by 1 having count(*) > 10 and max(c_acctbal) > 5000"),
    "agg_having_var": ("with avg(o_totalprice) as a select o_orderpriority, round(a, 2) as avg_price from orders group by o_orderpriority having a > 1000", "select o_orderpriority, round(avg(o_totalprice), 2) as avg_price from orders group by 1 having avg(o_totalprice) > 1000"),
    "agg_order_by_agg": ("select top 7 o_custkey, count(*) as n from orders group by o_custkey order by count(*) desc, max(o_custkey) asc", "select o_custkey, count(*)::double as n from orders group by 1 order by n desc, 1 limit 7"),
    "agg_expr_over_aggs": ("select l_returnflag, sum(l_quantity) / count(*) * 2 as r, max(l_tax) - min(l_tax) as spread from lineitem group by l_returnflag", "select l_returnflag, sum(l_quantity) / (count(*) * 2) as r, max(l_tax) - min(l_tax) as spread from lineitem group by 1"),
    "distinct_rows": ("select distinct p_type, p_brand from part", "select distinct p_type, p_brand from part"),
    "distinct_ordered": ("select distinct top 10 p_brand from part order by p_brand desc", "select distinct p_brand from part order by p_brand desc limit 10"),
    "distinct_aggregate": ("select distinct count(*) as n from orders group by o_custkey", "select distinct count(*)::double as n from orders group by o_custkey"),
    # sorting and limits
    "sort_asc_desc": ("select s_nationkey, s_suppkey from supplier order by s_nationkey desc, s_suppkey asc limit 30", "select s_nationkey, s_suppkey from supplier order by s_nationkey desc, s_suppkey limit 30"),
    "sort_expr": ("select o_orderkey from orders order by o_totalprice - o_custkey desc, o_orderkey limit 25", "select o_orderkey from orders order by o_totalprice - o_custkey desc, o_orderkey limit 25"),
    "sort_null_as_zero": (f"select p_partkey, {_SIZE} as sz from part order by sz asc, p_partkey desc limit 20", f"select p_partkey, ({_SIZE})::bigint as sz from part order by coalesce({_SIZE}, 0), p_partkey desc limit 20"),
    "top_k": ("select top 10 l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 10"),
    "limit_zero_is_all": ("select r_name from region limit 0", "select r_name from region"),
    "limit_over_top": ("select top 3 n_name from nation order by n_name limit 5", "select n_name from nation order by n_name limit 5"),
    # functions
    "fn_abs": ("select s_suppkey, abs(s_acctbal - 5000) as a, abs(0 - s_suppkey) as b from supplier", "select s_suppkey, abs(s_acctbal - 5000) as a, abs(0 - s_suppkey) as b from supplier"),
    "fn_round_ceil_floor": (
        "select s_suppkey, round(s_acctbal) as r, ceil(s_acctbal) as c, floor(s_acctbal) as f, round(s_acctbal, 1) as r1, floor(s_acctbal, -2) as f2 from supplier",
        "select s_suppkey, round(s_acctbal) as r, ceil(s_acctbal)::double as c, floor(s_acctbal)::double as f, round(s_acctbal * 10) / 10 as r1, floor(s_acctbal / 100)::double * 100 as f2 from supplier",
    ),
    "fn_trig": ("select p_partkey, round(sin(p_size), 9) as s, round(cos(p_size), 9) as c, round(tan(p_size), 9) as t, round(atan(p_size), 9) as a from part", "select p_partkey, round(sin(p_size), 9) as s, round(cos(p_size), 9) as c, round(tan(p_size), 9) as t, round(atan(p_size), 9) as a from part"),
    "fn_inverse_trig_null": ("select p_partkey, round(acos(p_size / 25.0), 9) as a, round(asin(p_size / 25.0), 9) as b from part", "select p_partkey, case when p_size <= 25 then round(acos(p_size / 25.0::double), 9) end as a, case when p_size <= 25 then round(asin(p_size / 25.0::double), 9) end as b from part"),
    "fn_log_null": ("select s_suppkey, round(log(s_suppkey), 9) as a, round(log2(s_suppkey), 9) as b, round(log10(s_suppkey), 9) as c from supplier", "select s_suppkey, case when s_suppkey > 0 then round(ln(s_suppkey), 9) end as a, case when s_suppkey > 0 then round(log2(s_suppkey), 9) end as b, case when s_suppkey > 0 then round(log10(s_suppkey), 9) end as c from supplier"),
    "fn_log_nan_option": ("NAN select n_nationkey, log(n_nationkey * 0) as a, pow(n_nationkey, 2) as b from nation", "select n_nationkey, '-inf'::double as a, (n_nationkey * n_nationkey)::bigint as b from nation"),
    "fn_sqrt_cbrt_exp": ("select s_suppkey, sqrt(s_suppkey - 10) as q, round(cbrt(s_suppkey), 9) as c, round(exp(0 - s_suppkey), 9) as e from supplier", "select s_suppkey, case when s_suppkey >= 10 then sqrt(s_suppkey - 10) end as q, round(cbrt(s_suppkey), 9) as c, round(exp(-s_suppkey), 9) as e from supplier"),
    "fn_pow": ("select n_nationkey, pow(n_nationkey, 3) as p from nation", "select n_nationkey, (n_nationkey * n_nationkey * n_nationkey)::bigint as p from nation"),
    "fn_upper_lower": ("select p_partkey, upper(p_name) as u, lower(p_brand) as l from part", "select p_partkey, upper(p_name) as u, lower(p_brand) as l from part"),
    "fn_len_bytes": (f"select p_partkey, len(p_name) as n, len({_BRAND}) as b, len(p_size) as s from part", f"select p_partkey, strlen(p_name)::double as n, coalesce(strlen({_BRAND}), 0)::double as b, strlen(p_size::varchar)::double as s from part"),
    "fn_substr_pos": ("select p_partkey, substr(p_name, 1, 4) as a, substr(p_brand, 7, 3) as b from part", "select p_partkey, substring(p_name, 2, 4) as a, case when strlen(p_brand) > 7 then substring(p_brand, 8, 3) end as b from part"),
    "fn_substr_regex": ("select p_partkey, substr(p_brand, '[0-9]+') as n, substr(p_name, 'o[a-z]') as o from part", "select p_partkey, nullif(regexp_extract(p_brand, '[0-9]+'), '') as n, nullif(regexp_extract(p_name, 'o[a-z]'), '') as o from part"),
    "fn_coalesce": (f"select p_partkey, coalesce({_BRAND}, p_type) as c, coalesce({_SIZE}, 0) as z from part", f"select p_partkey, coalesce({_BRAND}, p_type) as c, coalesce({_SIZE}, 0)::bigint as z from part"),
    "fn_md5": ("select n_name, md5(n_name) as h from nation", "select n_name, to_base64(unhex(md5(n_name))) as h from nation"),
    "fn_sha1": ("select n_name, sha1(n_name) as h from nation", "select n_name, to_base64(unhex(sha1(n_name))) as h from nation"),
    "fn_sha256": ("select n_name, sha256(n_name) as h from nation", "select n_name, to_base64(unhex(sha256(n_name))) as h from nation"),
    "fn_base64": ("select n_name, base64_encode(n_name) as e, base64_decode(base64_encode(n_name)) as d from nation", "select n_name, to_base64(n_name::blob) as e, n_name as d from nation"),
    "fn_casts": (
        "select s_suppkey, int(s_acctbal) as i, float(s_suppkey) as f, string(s_suppkey) as s, text(s_acctbal) as t, int('12abc') as p, int(substr(s_name, 9, 9)) as k from supplier",
        "select s_suppkey, trunc(s_acctbal)::bigint as i, s_suppkey::double as f, s_suppkey::varchar as s, printf('%.10g', s_acctbal) as t, 12::bigint as p, substring(s_name, 10, 9)::bigint as k from supplier",
    ),
    "fn_cast_dates": ("select n_nationkey, date('5/18/1955') + '2 days' as d, duration('90m') / duration('1h') as h from nation", "select n_nationkey, timestamp '1955-05-20' as d, 1.5::double as h from nation"),
    "fn_date_parts": (
        "select event_id, year(ts) as y, month(ts) as mo, dayofmonth(ts) as d, dayofyear(ts) as yd, hour(ts) as h, minute(ts) as mi, second(ts) as s from events",
        "select event_id, year(ts) as y, month(ts) as mo, day(ts) as d, dayofyear(ts) as yd, hour(ts) as h, minute(ts) as mi, second(ts) as s from events",
    ),
    "fn_week": ("select o_orderkey, week(o_orderdate) as w from orders", "select o_orderkey, dayofyear(o_orderdate) // 7 + 1 as w from orders"),
    "fn_day_of_week": ("select o_orderkey, day(o_orderdate) as a, dayofweek(o_orderdate) as b from orders", "select o_orderkey, dayofweek(o_orderdate) + 1 as a, dayofweek(o_orderdate) + 1 as b from orders"),
    "fn_names": ("select o_orderkey, monthname(o_orderdate) as m, dayname(o_orderdate) as d from orders", "select o_orderkey, monthname(o_orderdate) as m, dayname(o_orderdate) as d from orders"),
    "fn_date_format": (
        "select event_id, format(ts, 1) as a, format(ts, 106) as b, format(ts, 121) as c, format(ts, 130) as d, format(ts, '%Y week day %a %j') as e from events",
        "select event_id, strftime(ts, '%m/%d/%y') as a, strftime(ts, '%d %b %Y') as b, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as c, strftime(ts, '%d %b %Y %I:%M:%S:%g%p') as d, strftime(ts, '%Y week day %a %j') as e from events",
    ),
    "date_plus_duration": (
        "select o_orderkey, o_orderdate + '3 weeks' as a, o_orderdate - '10 years' as b, o_orderdate + '5 ms' as c, '1.5h' + o_orderdate as d from orders",
        "select o_orderkey, o_orderdate + interval 21 day as a, o_orderdate - interval 10 year as b, o_orderdate + interval 5 millisecond as c, o_orderdate + interval 90 minute as d from orders",
    ),
    "date_diff_duration": (
        "select event_id, ts - '2024-01-01' as since, (ts - '1/1/2024') / '1 day' as days, (ts - '2024-01-01') * 2 as twice from events where ts < '2024-01-01 23:00'",
        """select event_id, since(u) as since, u / 86400000000.0::double as days, since(2 * u) as twice from (select event_id, ts, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as u from events where ts < timestamp '2024-01-01 23:00') t""",
    ),
    "count_rows_by_hour": ("with hour(ts) as h select h, event_type, count(*) as n, round(sum(value), 2) as v from events group by h, event_type", "select hour(ts) as h, event_type, count(*)::double as n, round(sum(value), 2) as v from events group by 1, 2"),
    # not for SQL
    "fn_rand": ("select n_nationkey, rand() as r from nation", None),
    "fn_inc": ("select inc() as n, n_name from nation", None),
    "group_by_inc": ("select inc() % 5 as k, count(*) as n from nation group by k", "select k::double as k, 5::double as n from range(5) t(k)"),
    "fn_now": ("select r_name, now() as a, nowgm() as b from region", None),
    "fn_encrypt_roundtrip": ("select n_name, decrypt(encrypt(n_name, 'pass'), 'pass') as d, decrypt(n_name, 'pass') as bad from nation", "select n_name, n_name as d, null::varchar as bad from nation"),
    "fn_sip": ("select n_name, sip(n_name) as h from nation", None),
}


#: Queries over delimited text, written from the tables first: query, how the text is written, SQL. A table's name in braces is its file.
TEXT: dict[str, tuple[str, dict[str, str], str]] = {
    "text_header": ("select c_custkey + 0 as k, c_name, c_acctbal * 2 as b from {customer}", {}, "select c_custkey as k, c_name, c_acctbal * 2 as b from customer"),
    "text_no_header": ("select c1 + 0 as k, c2 as name from {nation} NH where c3 > 2", {"header": "false"}, "select n_nationkey::bigint as k, n_name as name from nation where n_regionkey > 2"),
    "text_tabs": ("select s_suppkey + 1 as k, s_name from {supplier} T", {"sep": "\t"}, "select s_suppkey + 1 as k, s_name from supplier"),
    "text_pipes": ("P select s_suppkey + 1 as k, s_name from {supplier} where s_acctbal between 500 and 100", {"sep": "|"}, "select s_suppkey + 1 as k, s_name from supplier where s_acctbal between 100 and 500"),
    "text_raw_columns": ("select o_totalprice, o_custkey + o_orderpriority as t from {orders}", {}, "select o_totalprice::varchar as o_totalprice, o_custkey::varchar || o_orderpriority as t from orders"),
    "text_dates": ("select o_orderkey + 0 as k, year(o_orderdate) as y, o_orderdate + '1 day' as d from {orders} where o_orderdate < '6/1/1996'", {}, "select o_orderkey as k, year(o_orderdate) as y, o_orderdate + interval 1 day as d from orders where o_orderdate < timestamp '1996-06-01'"),
    "text_quoted": ("select event_id + 0 as k, props from {events} where props like '%\"k\": 1%'", {}, "select event_id as k, props from events where props like '%\"k\": 1%'"),
    "text_join_group": (
        "select n.n_name, count(*) as c, round(sum(s.s_acctbal), 2) as t from {supplier} s join {nation} n on s.s_nationkey = n.n_nationkey group by n.n_name",
        {},
        "select n_name, count(*)::double as c, round(sum(s_acctbal), 2) as t from supplier join nation on s_nationkey = n_nationkey group by 1",
    ),
    "text_first_and_last": (
        "select c_mktsegment, c_name, substr(c_name, 9, 9) as last, count(*) as n from {customer} group by c_mktsegment",
        {},
        "select c_mktsegment, arg_min(c_name, c_custkey) as c_name, substring(arg_max(c_name, c_custkey), 10, 9) as last, count(*)::double as n from customer group by 1",
    ),
    "text_limit_in_file_order": ("select n_name, r.r_name from {nation} n join {region} r on n.n_regionkey = r.r_regionkey limit 7", {}, "select n_name, r_name from nation join region on n_regionkey = r_regionkey order by n_nationkey limit 7"),
    "text_distinct_in_file_order": ("select distinct top 3 c_mktsegment from {customer}", {}, "select c_mktsegment from customer group by 1 order by min(c_custkey) limit 3"),
    "text_row_numbers": ("select inc() as i, n_name from {nation} where n_regionkey <> 2", {}, "select row_number() over (order by n_nationkey)::double as i, n_name from nation where n_regionkey <> 2"),
    "text_in_subquery": ("select c_name from {customer} where c_custkey not in (select o_custkey from {orders} where o_totalprice > 100000)", {}, "select c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)"),
}


def _since_sql(u: str) -> str:
    """Duration text in SQL."""
    part = lambda width, of, sign: f"case when ({u}) % {of} // {width} > 0 then (({u}) % {of} // {width})::varchar || '{sign}' else '' end"
    rest = f"({u}) % 1000000"
    small = f"case when {rest} = 0 then '' when {rest} % 1000 = 0 then ({rest} // 1000)::varchar || 'ms' else ({rest})::varchar || 'mcs' end"
    days = f"case when ({u}) // 86400000000 > 0 then (({u}) // 86400000000)::varchar || 'd' else '' end"
    return f"case when ({u}) = 0 then '0d' else {days} || {part(3600000000, 86400000000, 'h')} || {part(60000000, 3600000000, 'm')} || {part(1000000, 60000000, 's')} || {small} end"


def _sql(text: str) -> str:
    return re.sub(r"since\(([^()]+)\)", lambda m: _since_sql(m[1]), text)


def engine_for(spark: SparkSession, sf_dir: str, text: str = "") -> Engine:
    """An engine with the tables that the text names, or all."""
    engine = Engine(spark, Options())
    for name in TABLES:
        if not text or re.search(rf"\b{name}\b", text):
            engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return engine


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_for(spark, sf_dir, text).sql(text)


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors see; a local one only where the session names none, as in local tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='millrace-')).rstrip('/')}/text-{uuid.uuid4().hex}"


#: Rows of a file of text, about.
FILE_ROWS = 500_000


def as_text(spark: SparkSession, sf_dir: str, text: str, form: dict[str, str]) -> str:
    """The query with its tables written as delimited text in the order of their first column: a file each, or for large ones a file for each range."""
    at = _scratch(spark)
    for name in sorted(set(re.findall(r"\{(\w+)\}", text))):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        n = -(-df.count() // FILE_ROWS)
        dealt = df.repartitionByRange(n, df.columns[0]) if n > 1 else df.coalesce(1)
        writer = dealt.sortWithinPartitions(df.columns[0]).write.option("escape", '"')
        writer.options(**{"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", **form}).csv(f"{at}/{name}.csv")
        text = text.replace("{" + name + "}", f"'{at}/{name}.csv'")
    return text


def _run_text(text: str, form: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark).sql(as_text(spark, sf_dir, text, form))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _run(text) for name, (text, _) in LANGUAGE.items()}
QUERIES |= {name: _run_text(text, form) for name, (text, form, _) in TEXT.items()}
ORACLE: dict[str, str] = {name: _sql(sql) for name, (_, sql) in LANGUAGE.items() if sql is not None}
ORACLE |= {name: sql for name, (_, _, sql) in TEXT.items()}
FLAGSHIP = "agg_group"
