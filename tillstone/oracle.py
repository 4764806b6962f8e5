"""Independent SQL for every query, to be run by DuckDB over the same star tables.

The texts compute from the raw tables in plain SQL (global windows, cross joins with four centres) what
the Spark plans compute in distributed form. Money is kept in whole cents, so sums and ratios are exact.
"""

from __future__ import annotations

from tillstone.operators.clustering import SETTLED
from tillstone.plans.checks import AMOUNT_LIMIT, ARMS, HIGH_VALUE_SHARE, TOP_SHARES
from tillstone.plans.eda import DISCOUNTS
from tillstone.plans.mart import CLUSTERS, RESTARTS
from tillstone.plans.rfm import SIZES
from tillstone.plans.views import TIER_COLUMNS
from tillstone.schemas import HIGH_VALUE_TIERS, MARKET_SEGMENTS, TEXT_LIMITS, TIERS


def ratio(top: str, bottom: str, digits: int) -> str:
    """Integer ratio rounded half away from zero."""
    scale = 10**digits
    return (
        f"case when ({bottom}) <> 0 then sign({top}) * sign({bottom}) * "
        f"cast((2 * {scale} * abs({top}) + abs({bottom})) // (2 * abs({bottom})) as double) / {scale}.0 end"
    )


def pct(part: str, whole: str, digits: int = 2) -> str:
    return ratio(f"(100 * ({part}))", f"({whole})", digits)


def mean_money(cents: str, n: str) -> str:
    return f"({ratio(f'({cents})', f'({n})', 0)}) / 100.0"


def money(cents: str) -> str:
    return f"cast({cents} as double) / 100.0"


def big(value: str) -> str:
    return f"cast({value} as bigint)"


AOV = mean_money("sum(cents)", "count(cents)")
RETURNS = pct("sum(returned)", "count(returned)")
REVENUE = money("sum(cents)")


def labels(values: list[str]) -> str:
    return ", ".join(f"({i}, '{value}')" for i, value in enumerate(values))


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{value}'" for value in values)


def gap(centre: str) -> str:
    terms = [f"(p.{z} - {centre}.{z}) * (p.{z} - {centre}.{z})" for z in ("zr", "zf", "zm")]
    return f"round({' + '.join(terms)}, 9)"


# name -> (tables it reads from this dictionary, text)
TABLES: dict[str, tuple[list[str], str]] = {
    "tx": (
        [],
        """
        select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))
                   as transaction_id,
               o_custkey as customer_id,
               cast(o_orderdate as date) as day,
               strftime(o_orderdate, '%Y-%m') as month,
               p_brand as category,
               cast(cast(l_extendedprice as decimal(12, 2)) * 100 as bigint) as price_cents,
               cast(l_quantity as bigint) as quantity,
               cast(round(l_discount * 100) as bigint) as discount_pct,
               (cast(cast(l_extendedprice as decimal(12, 2)) * 100 as bigint)
                   * (100 - cast(round(l_discount * 100) as bigint)) + 50) // 100 as cents,
               o_orderpriority as payment_mode,
               cast(l_returnflag = 'R' as bigint) as returned
        from lineitem
        join orders on o_orderkey = l_orderkey
        join part on p_partkey = l_partkey""",
    ),
    "shoppers": (
        [],
        """
        select c_custkey as customer_id, r_name as gender, c_mktsegment as age_group, n_name as city
        from customer
        join nation on n_nationkey = c_nationkey
        join region on r_regionkey = n_regionkey""",
    ),
    "sold": (["tx", "shoppers"], "select tx.*, gender, age_group, city from tx join shoppers using (customer_id)"),
    "months": (["tx"], f"select month, {big('sum(cents)')} as cents from tx group by month"),
    "spend": (
        ["tx"],
        """
        select customer_id, sum(cents) as cents, count(*) as orders,
               row_number() over (order by sum(cents) desc, customer_id) as place, count(*) over () as everyone
        from tx group by customer_id""",
    ),
    "firsts": (["tx"], "select customer_id, min(month) as cohort_month from tx group by customer_id"),
    "rfm": (
        ["tx"],
        f"""
        select customer_id,
               date_diff('day', max(day), (select max(day) + 1 from tx)) as recency,
               count(transaction_id) as frequency,
               {big('sum(cents)')} as cents,
               {money('sum(cents)')} as monetary
        from tx group by customer_id""",
    ),
    "cuts": (
        ["rfm"],
        """
        select quantile_cont(cast(recency as double), [0.2, 0.4, 0.6, 0.8]) as r,
               quantile_cont(cast(turn as double), [0.2, 0.4, 0.6, 0.8]) as f,
               quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) as m
        from (select *, row_number() over (order by frequency, customer_id) as turn from rfm)""",
    ),
    "scored": (
        ["rfm", "cuts"],
        """
        select *, r_score + f_score + m_score as rfm_score
        from (
            select t.*,
                   5 - len(list_filter(cuts.r, lambda e: t.recency > e)) as r_score,
                   1 + len(list_filter(cuts.f, lambda e: t.turn > e)) as f_score,
                   1 + len(list_filter(cuts.m, lambda e: t.monetary > e)) as m_score
            from (select *, row_number() over (order by frequency, customer_id) as turn from rfm) t, cuts)""",
    ),
    "points": (
        ["scored"],
        """
        select s.*,
               round((recency - mr) / dr, 6) as zr,
               round((frequency - mf) / df, 6) as zf,
               round((monetary - mm) / dm, 6) as zm,
               row_number() over (order by cents desc, customer_id) as place
        from scored s, (
            select avg(cast(recency as double)) as mr, stddev_pop(cast(recency as double)) as dr,
                   avg(cast(frequency as double)) as mf, stddev_pop(cast(frequency as double)) as df,
                   avg(monetary) as mm, stddev_pop(monetary) as dm
            from scored)""",
    ),
}

# Coordinates in millionths, and their place in the order of the MD5 of the ids.
TABLES["grid"] = (
    ["points"],
    """
    select customer_id, row_number() over (order by md5(cast(customer_id as varchar)), customer_id) - 1 as draw,
           cast(round(zr * 1000000) as bigint) as x, cast(round(zf * 1000000) as bigint) as y,
           cast(round(zm * 1000000) as bigint) as z
    from points""",
)


def _floored(top: str, bottom: str) -> str:
    return f"((({top}) - ((({top}) % ({bottom})) + ({bottom})) % ({bottom})) // ({bottom}))"


def _mean(axis: str) -> str:
    return f"cast({_floored(f'2 * sum({axis}) + count(*)', '2 * count(*)')} as bigint)"


#: Number of the closest of the centres ``cs``, counted from 1.
CLOSEST = """cast(list_position(
    list_transform(cs, lambda c: cast(p.x - c.x as double) * cast(p.x - c.x as double)
        + cast(p.y - c.y as double) * cast(p.y - c.y as double) + cast(p.z - c.z as double) * cast(p.z - c.z as double)),
    list_min(list_transform(cs, lambda c: cast(p.x - c.x as double) * cast(p.x - c.x as double)
        + cast(p.y - c.y as double) * cast(p.y - c.y as double) + cast(p.z - c.z as double) * cast(p.z - c.z as double)))) as bigint)"""


def _fits(sizes: list[int], restarts: int) -> str:
    """Final centres of every run (k, r), by Lloyd's steps until the centres settle: those of the last assignment."""
    largest = max(sizes)
    return f"""
    with recursive state(k, r, step, moved, cs) as (
        select k, r, 0, true, list({{'x': x, 'y': y, 'z': z}} order by j)
        from (select unnest({sizes}) as k) cross join (select unnest(range({restarts})) as r)
        cross join (select unnest(range({largest})) as j)
        join grid on draw = (r * {largest} + j) % least({largest * restarts}, (select count(*) from grid))
        where j < k group by k, r
        union all
        select k, r, step + 1, list_sum(list_transform(range(1, k + 1), lambda i:
            cast(new[i].x - cs[i].x as hugeint) * (new[i].x - cs[i].x) + cast(new[i].y - cs[i].y as hugeint) * (new[i].y - cs[i].y)
            + cast(new[i].z - cs[i].z as hugeint) * (new[i].z - cs[i].z))) > {SETTLED}, new
        from (
            select k, r, step, cs, list_transform(range(1, k + 1), lambda i: coalesce(
                list_extract(list_filter(found, lambda f: f.cluster = i), 1).mean, cs[i])) as new
            from (
                select k, r, step, cs, list({{'cluster': cluster, 'mean': mean}}) as found
                from (
                    select k, r, step, cs, cluster, {{'x': {_mean('x')}, 'y': {_mean('y')}, 'z': {_mean('z')}}} as mean
                    from (
                        select k, r, step, cs, p.x, p.y, p.z, {CLOSEST} as cluster
                        from state, grid p where moved and step < 299)
                    group by k, r, step, cs, cluster)
                group by k, r, step, cs)))
    select k, r, arg_max(cs, step) filter (where moved) as cs from state group by k, r"""


def _labelled(fit: str) -> str:
    """Points with cluster and segment, by the centres of one run."""
    return f"""
    select p.*, a.cluster, named.segment
    from points p
    join (select customer_id, {CLOSEST} - 1 as cluster from grid p, ({fit})) a using (customer_id)
    join (
        select cluster, [{quoted(TIERS)}][row_number() over (order by avg(monetary) desc, cluster)] as segment
        from points join (select customer_id, {CLOSEST} - 1 as cluster from grid p, ({fit})) using (customer_id)
        group by cluster) named
      on named.cluster = a.cluster"""


TABLES["one_fit"] = (["grid"], _fits([CLUSTERS], 1))
TABLES["fits"] = (["grid"], _fits(list(SIZES), RESTARTS))
TABLES["four_fits"] = (["grid"], _fits([CLUSTERS], RESTARTS))


def _best(fits: str) -> str:
    return f"""
    select k, arg_min(cs, (cost, r)) as cs, min(cost) as cost
    from (
        select k, r, any_value(cs) as cs,
               sum(cast(p.x - cs[c].x as hugeint) * (p.x - cs[c].x) + cast(p.y - cs[c].y as hugeint) * (p.y - cs[c].y)
                   + cast(p.z - cs[c].z as hugeint) * (p.z - cs[c].z)) as cost
        from (select k, r, cs, p.x, p.y, p.z, {CLOSEST} as c from {fits}, grid p) p group by k, r)
    group by k"""


TABLES["best_fits"] = (["grid", "fits"], _best("fits"))
TABLES["seg"] = (["points", "grid", "one_fit"], _labelled("select cs from one_fit"))
TABLES["best_seg"] = (
    ["points", "grid", "four_fits"],
    _labelled(f"select cs from ({_best('four_fits')})"),
)
TABLES["gaps"] = (
    ["seg"],
    f"""
    select p.customer_id, c.cluster, count(*) as n, sum({gap('c')}) as total
    from seg p join seg c on true group by p.customer_id, c.cluster""",
)
TABLES["seg_tx"] = (["tx", "seg"], "select tx.*, segment from tx join seg using (customer_id)")
TABLES["seg_sums"] = (
    ["seg"],
    "select segment, count(*) as n, sum(cents) as cents, avg(monetary) as mean from seg group by segment",
)
TABLES["tiers"] = ([], f"select * from (values {labels(TIERS)}) as t(ord, segment)")

SEGMENT_PROFILE = f"""
    select segment, count(*) as customers,
           {ratio('sum(recency)', 'count(*)', 1)} as avg_recency_days,
           {ratio('sum(frequency)', 'count(*)', 1)} as avg_orders,
           {mean_money('sum(cents)', 'count(*)')} as avg_revenue,
           {REVENUE} as total_revenue,
           {pct('sum(cents)', 'sum(sum(cents)) over ()')} as revenue_pct
    from seg group by segment"""

HIGH_VALUE = """
    select seg.customer_id, segment, age_group, city, gender, recency, frequency, monetary as {spend},
           rfm_score as "RFM_score"
    from seg join shoppers using (customer_id)
    where segment in ({tiers})"""

COHORTS = f"""
    select cohort_month, count(distinct customer_id) as customers, {REVENUE} as total_revenue,
           {AOV} as avg_order_value
    from tx join firsts using (customer_id)
    group by cohort_month"""


def _rule(table: str, rule: str, broken: str) -> str:
    return (
        f"select '{table.split('/')[0]}' as table_name, '{rule}' as rule, "
        f"count(*) filter (where {broken}) as violations from {table.split('/')[1]}"
    )


DOMAIN_RULES = " union all ".join(
    [
        _rule("customers/shoppers", f"{column}_length", f"length(cast({column} as varchar)) > {limit}")
        for column, limit in TEXT_LIMITS["customers"].items()
    ]
    + [
        _rule("transactions/tx", f"{column}_length", f"length(cast({column} as varchar)) > {limit}")
        for column, limit in TEXT_LIMITS["transactions"].items()
    ]
    + [
        _rule("transactions/tx", "returned_flag", "returned not in (0, 1)"),
        _rule("transactions/tx", "discount_range", "discount_pct < 0 or discount_pct > 100"),
        _rule("transactions/tx", "quantity_positive", "quantity < 1"),
        _rule(
            "transactions/tx",
            "amount_precision",
            f"abs(price_cents) >= {AMOUNT_LIMIT * 100} or abs(cents) >= {AMOUNT_LIMIT * 100}",
        ),
        _rule("transactions/tx", "amount_sign", "cents < 0"),
    ]
)

PROFILED = {
    "transaction_id": "transaction_id",
    "customer_id": "customer_id",
    "transaction_date": "day",
    "category": "category",
    "product_amount": "cast(price_cents as decimal(14, 0)) * cast(0.01 as decimal(3, 2))",
    "quantity": "quantity",
    "discount_pct": "discount_pct",
    "final_amount": "cast(cents as decimal(14, 0)) * cast(0.01 as decimal(3, 2))",
    "payment_mode": "payment_mode",
    "returned": "returned",
}

PROFILE = " union all ".join(
    f"""
    select cast({i} as bigint) as ordinal, '{name}' as column_name,
           least(greatest({len(name)}, max(length(cast({source} as varchar)))) + 4, 30) as width,
           count(*) - count({source}) as nulls, count(distinct {source}) as distincts
    from tx"""
    for i, (name, source) in enumerate(PROFILED.items(), 1)
)


def _arm() -> str:
    branches, reached = [], 0.0
    for label, weight in ARMS.items():
        reached += weight
        branches.append(f"when bucket < {round(reached * 10_000)} then '{label}'")
    return "case " + " ".join(branches) + " end"


def _pk(table: str, key: str, name: str) -> str:
    return f"""
    select '{name}' as table_name, '{key}' as key_columns, {big('sum(n)')} as row_count,
           {big('coalesce(sum(n) filter (where k is null), 0)')} as null_keys,
           count(*) filter (where k is not null and n > 1) as duplicate_keys
    from (select {key} as k, count(*) as n from {table} group by 1)"""


def _fk(table: str, name: str) -> str:
    return f"""
    select '{name}' as child_table, 'customers' as parent_table, 'customer_id' as key_column,
           count(distinct customer_id) as orphan_keys, count(*) as orphan_rows
    from {table} where customer_id not in (select customer_id from shoppers)"""


BOX_METRICS = " union all ".join(
    f"select segment, '{metric}' as metric, cast({metric} as double) as amount from seg"
    for metric in ("recency", "frequency", "monetary")
)

# key -> (tables it reads, text)
TEXTS: dict[str, tuple[list[str], str]] = {
    "eda_summary": (
        ["tx", "shoppers"],
        f"""
        select (select count(*) from shoppers) as customers, count(*) as transactions, {REVENUE} as revenue,
               {AOV} as avg_order_value, {pct('sum(returned)', 'count(returned)', 1)} as return_rate_pct
        from tx""",
    ),
    "revenue_by_category": (
        ["tx"],
        f"select category, {REVENUE} as revenue, {REVENUE} / 1e6 as revenue_millions from tx group by category",
    ),
    "revenue_by_age_group": (
        ["sold"],
        f"""
        select d.age_group, {REVENUE} as revenue, {REVENUE} / 1e6 as revenue_millions
        from (values {labels(MARKET_SEGMENTS)}) as d(ord, age_group) left join sold using (age_group)
        group by d.age_group""",
    ),
    "payment_mode_distribution": (
        ["tx"],
        f"""
        select payment_mode, count(*) as n, {pct('count(*)', 'sum(count(*)) over ()', 1)} as pct
        from tx group by payment_mode""",
    ),
    "monthly_revenue": (
        ["months"],
        f"select month, {money('cents')} as revenue, {money('cents')} / 1e6 as revenue_millions from months",
    ),
    "order_value_histogram": (
        ["tx"],
        """
        select bins.bin, round(lo + bins.bin * width, 4) as lo, round(lo + (bins.bin + 1) * width, 4) as hi,
               count(rows.bin) as n
        from (select range as bin from range(50)) bins
        cross join (select min(cents / 100.0) as lo, (max(cents / 100.0) - min(cents / 100.0)) / 50 as width from tx)
        left join (
            select least(cast(floor((cents / 100.0 - lo) / width) as bigint), 49) as bin
            from tx, (select min(cents / 100.0) as lo, (max(cents / 100.0) - min(cents / 100.0)) / 50 as width from tx)
        ) rows on rows.bin = bins.bin
        group by bins.bin, lo, width""",
    ),
    "order_value_center": (
        ["tx"],
        f"select {AOV} as mean_value, round(median(cast(cents as double)) / 100.0, 4) as median_value from tx",
    ),
    "revenue_by_city": (
        ["sold"],
        f"select city, {REVENUE} as revenue, {REVENUE} / 1e6 as revenue_millions from sold group by city",
    ),
    "category_discount_pivot": (
        ["tx"],
        "select category, "
        + ", ".join(
            mean_money(
                f"sum(cents) filter (where discount_pct = {d})", f"count(*) filter (where discount_pct = {d})"
            )
            + f" as d{d}"
            for d in DISCOUNTS
        )
        + ", cast(null as varchar) as other from tx group by category",
    ),
    "csv_round_trip": (
        ["tx"],
        f"""
        select category, count(*) as total_orders, {REVENUE} as total_revenue, {AOV} as avg_order_value,
               {RETURNS} as return_rate_pct, cast(0 as bigint) as rejected
        from tx group by category""",
    ),
    "top5_categories": (
        ["tx"],
        f"select category, {REVENUE} as revenue from tx group by category order by sum(cents) desc, category limit 5",
    ),
    "revenue_by_gender": (["sold"], f"select gender, {REVENUE} as revenue from sold group by gender"),
    "rfm_base": (["rfm"], "select customer_id, recency, frequency, monetary from rfm"),
    "rfm_scores": (
        ["scored"],
        """
        select customer_id, recency, frequency, monetary, r_score as "R_score", f_score as "F_score",
               m_score as "M_score", rfm_score as "RFM_score"
        from scored""",
    ),
    "rfm_scaled": (["points"], "select customer_id, zr, zf, zm from points"),
    "lloyd_segments": (["seg"], "select customer_id, cluster, segment from seg"),
    "kmeans_segments": (
        ["best_seg"],
        """
        select customer_id, recency, frequency, monetary, r_score as "R_score", f_score as "F_score",
               m_score as "M_score", rfm_score as "RFM_score", cluster, segment
        from best_seg""",
    ),
    "kmeans_sweep": (
        ["points", "grid", "best_fits"],
        f"""
        with clustered as (
            select k, p.customer_id, p.zr, p.zf, p.zm, c
            from (select k, p.customer_id, {CLOSEST} as c from best_fits, grid p) join points p using (customer_id)
        ), gaps as (
            select a.k, a.customer_id, a.c, b.c as other, count(*) as n,
                   sum((a.zr - b.zr) * (a.zr - b.zr) + (a.zf - b.zf) * (a.zf - b.zf) + (a.zm - b.zm) * (a.zm - b.zm)) as total
            from clustered a join clustered b on a.k = b.k group by all
        ), scores as (
            select k, customer_id, max(n) filter (where c = other) as n,
                   max(total / nullif(n - 1, 0)) filter (where c = other) as a, min(total / n) filter (where c <> other) as b
            from gaps group by k, customer_id
        )
        select cast(k as bigint) as k, round(cast(any_value(cost) as double) / 1e12, 6) as inertia,
               round(avg(case when n = 1 or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6)
                   as silhouette
        from scores join best_fits using (k) group by k""",
    ),
    "silhouette_by_cluster": (
        ["seg", "gaps"],
        """
        select cluster, count(*) as customers,
               round(avg(case when n = 1 or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6)
                   as silhouette
        from (
            select x.customer_id, x.cluster, any_value(own.n) as n,
                   any_value(own.total) / nullif(any_value(own.n) - 1, 0) as a, min(other.total / other.n) as b
            from seg x
            join gaps own on own.customer_id = x.customer_id and own.cluster = x.cluster
            join gaps other on other.customer_id = x.customer_id and other.cluster <> x.cluster
            group by x.customer_id, x.cluster)
        group by cluster""",
    ),
    "cluster_summary": (
        ["seg"],
        f"""
        select cluster, segment, {ratio('sum(recency)', 'count(*)', 2)} as avg_recency,
               {ratio('sum(frequency)', 'count(*)', 2)} as avg_frequency,
               {mean_money('sum(cents)', 'count(*)')} as avg_monetary, count(*) as customer_count
        from seg group by cluster, segment""",
    ),
    "segment_distribution": (
        ["seg_sums"],
        f"select segment, n, {pct('n', 'sum(n) over ()', 1)} as pct from seg_sums",
    ),
    "segment_box_stats": (
        ["seg"],
        f"""
        with long as ({BOX_METRICS}),
        boxes as (select segment, metric, quantile_cont(amount, [0.0, 0.25, 0.5, 0.75, 1.0]) as q
                  from long group by segment, metric),
        fenced as (select l.*, q, amount between q[2] - 1.5 * (q[4] - q[2]) and q[4] + 1.5 * (q[4] - q[2]) as inside
                   from long l join boxes using (segment, metric))
        select segment, metric, round(q[1], 4) as least, round(q[2], 4) as q1, round(q[3], 4) as med,
               round(q[4], 4) as q3, round(q[5], 4) as most,
               round(min(amount) filter (where inside), 4) as whisker_lo,
               round(max(amount) filter (where inside), 4) as whisker_hi,
               count(*) filter (where not inside) as outliers
        from fenced group by segment, metric, q""",
    ),
    "freq_vs_monetary": (
        ["seg"],
        "select customer_id, segment, frequency, monetary / 1e3 as monetary_thousands from seg",
    ),
    "segment_revenue_share": (
        ["seg_sums"],
        f"select segment, {money('cents')} as revenue, {pct('cents', 'sum(cents) over ()', 1)} as pct from seg_sums",
    ),
    "segment_report": (
        ["tiers", "seg_sums"],
        f"""
        select segment, coalesce(n, 0) as customers, coalesce({money('cents')}, 0) as revenue, coalesce(pct, 0) as pct
        from tiers left join (
            select *, {pct('cents', 'sum(cents) over ()', 1)} as pct from seg_sums) using (segment)""",
    ),
    "top20_customers": (
        ["sold"],
        f"""
        select customer_id, age_group, city, count(transaction_id) as orders, {REVENUE} as total_spent,
               rank() over (order by sum(cents) desc) as revenue_rank,
               {money('sum(sum(cents)) over (order by sum(cents) desc)')} as running_total
        from sold group by customer_id, age_group, city
        order by sum(cents) desc, customer_id limit 20""",
    ),
    "segment_contribution": (["seg"], SEGMENT_PROFILE),
    "cohort_revenue_12": (["tx", "firsts"], COHORTS + " order by cohort_month nulls first limit 12"),
    "category_cumulative": (
        ["tx"],
        f"""
        select category, count(transaction_id) as total_orders, {REVENUE} as total_revenue, {AOV} as avg_order_value,
               rank() over (order by sum(cents) desc nulls last) as revenue_rank,
               {pct('sum(sum(cents)) over (order by sum(cents) desc nulls last)', 'sum(sum(cents)) over ()')}
                   as cumulative_pct
        from tx group by category""",
    ),
    "mom_growth": (
        ["months"],
        f"""
        select month, {money('cents')} as revenue, {money('before')} as prev_month,
               {pct('cents - before', 'before')} as mom_growth_pct
        from (select *, lag(cents) over (order by month nulls first) as before from months)""",
    ),
    "segment_category_matrix": (
        ["seg_tx"],
        f"""
        select segment, category, count(transaction_id) as orders, {REVENUE} as total_revenue
        from seg_tx group by segment, category""",
    ),
    "return_rate_by_segment": (
        ["seg_tx"],
        f"""
        select segment, count(transaction_id) as total_orders, {big('sum(returned)')} as returned_orders,
               {RETURNS} as return_rate_pct
        from seg_tx group by segment""",
    ),
    "segment_demographics_export": (
        ["sold", "seg"],
        f"""
        select segment, age_group, city, gender, count(transaction_id) as total_orders,
               {money('sum(sold.cents)')} as total_revenue,
               {mean_money('sum(sold.cents)', 'count(sold.cents)')} as avg_order_value,
               {RETURNS} as return_rate_pct
        from sold join seg using (customer_id) group by segment, age_group, city, gender""",
    ),
    "vw_kpi_summary": (
        ["tx", "shoppers", "seg"],
        f"""
        select count(distinct s.customer_id) as total_customers, count(tx.transaction_id) as total_transactions,
               {money('sum(tx.cents)')} as total_revenue,
               {mean_money('sum(tx.cents)', 'count(tx.cents)')} as avg_order_value,
               {pct('sum(tx.returned)', 'count(tx.returned)')} as return_rate_pct,
               """
        + ", ".join(
            f"count(distinct seg.customer_id) filter (where seg.segment = '{tier}') as {column}"
            for tier, column in TIER_COLUMNS.items()
        )
        + """
        from shoppers s
        left join tx on tx.customer_id = s.customer_id
        left join seg on seg.customer_id = s.customer_id""",
    ),
    "vw_rfm_segments": (
        ["seg", "shoppers"],
        """
        select customer_id, segment, age_group, city, gender, recency, frequency, monetary, r_score as "R_score",
               f_score as "F_score", m_score as "M_score", rfm_score as "RFM_score"
        from seg join shoppers using (customer_id)""",
    ),
    "vw_segment_summary": (["seg"], SEGMENT_PROFILE),
    "vw_category_performance": (
        ["tx"],
        f"""
        select category, count(transaction_id) as total_orders, {REVENUE} as total_revenue, {AOV} as avg_order_value,
               {RETURNS} as return_rate_pct, rank() over (order by sum(cents) desc nulls last) as revenue_rank
        from tx group by category""",
    ),
    "vw_monthly_trend": (
        ["tx"],
        f"""
        select month, year(day) as year, month(day) as month_num, monthname(day) as month_name,
               count(transaction_id) as total_orders, {REVENUE} as total_revenue, {AOV} as avg_order_value,
               {big('sum(returned)')} as returns
        from tx group by all""",
    ),
    "vw_city_performance": (
        ["sold"],
        f"""
        select city, count(distinct customer_id) as customers, count(transaction_id) as orders,
               {REVENUE} as total_revenue, {AOV} as avg_order_value
        from sold group by city""",
    ),
    "vw_segment_x_category": (
        ["seg_tx"],
        f"""
        select segment, category, count(transaction_id) as orders, {REVENUE} as revenue, {AOV} as avg_order_value
        from seg_tx group by segment, category""",
    ),
    "vw_high_value_customers": (
        ["seg", "shoppers"],
        HIGH_VALUE.format(spend="lifetime_value", tiers=quoted(HIGH_VALUE_TIERS)),
    ),
    "quintile_pareto": (
        ["spend"],
        f"""
        select quintile, count(*) as customers, {REVENUE} as revenue,
               {pct('sum(cents)', 'sum(sum(cents)) over ()')} as revenue_pct
        from (select *, ntile(5) over (order by cents desc, customer_id) as quintile from spend)
        group by quintile""",
    ),
    "cohort_revenue": (["tx", "firsts"], COHORTS),
    "dash_kpis": (
        ["tx", "seg"],
        f"""
        select count(distinct customer_id) as total_customers, {REVENUE} as total_revenue,
               {REVENUE} / 1e6 as total_revenue_millions, (select {AOV} from tx) as avg_order_value
        from seg""",
    ),
    "dash_segment_revenue": (
        ["tiers", "seg_sums"],
        f"""
        select segment, {money('cents')} as revenue, {money('cents')} / 1e6 as revenue_millions,
               {pct('cents', '(select sum(cents) from seg_sums)', 1)} as pct
        from tiers left join seg_sums using (segment)""",
    ),
    "dash_segment_count": (
        ["tiers", "seg_sums"],
        f"""
        select segment, n, {pct('n', '(select sum(n) from seg_sums)', 0)} as pct
        from tiers left join seg_sums using (segment)""",
    ),
    "dash_segment_avg": (
        ["tiers", "seg_sums"],
        f"""
        select segment, {mean_money('cents', 'n')} as avg_monetary,
               round({money('cents')} / 1e3 / n, 1) as avg_monetary_thousands
        from tiers left join seg_sums using (segment)""",
    ),
    "bi_kpi_long": (
        ["tx", "shoppers", "seg"],
        f"""
        unpivot (
            select (select cast(count(*) as double) from shoppers) as "Total Customers",
                   cast(count(*) as double) as "Total Transactions", {REVENUE} as "Total Revenue (Rs.)",
                   {AOV} as "Avg Order Value (Rs.)", {RETURNS} as "Return Rate (%)",
                   """
        + ", ".join(
            f"""(select cast(count(*) as double) from seg where segment = '{tier}') as "{label}" """
            for tier, label in zip(
                TIERS, ["Champions Count", "Loyal Customers Count", "At Risk Count", "Lost/Inactive Count"]
            )
        )
        + """
            from tx)
        on columns(*) into name "KPI" value "Value" """,
    ),
    "bi_by_category": (
        ["tx"],
        f"""
        select category, count(*) as total_orders, {REVENUE} as total_revenue, {AOV} as avg_order_value,
               {RETURNS} as return_rate_pct
        from tx group by category""",
    ),
    "bi_by_city": (
        ["sold"],
        f"""
        select city, count(distinct customer_id) as customers, count(transaction_id) as orders,
               {REVENUE} as total_revenue
        from sold group by city""",
    ),
    "bi_by_age_group": (
        ["sold"],
        f"""
        select age_group, count(distinct customer_id) as customers, {AOV} as avg_order_value,
               {REVENUE} as total_revenue
        from sold group by age_group""",
    ),
    "bi_monthly_trend": (
        ["tx"],
        f"""
        select month, count(*) as orders, {REVENUE} as revenue, {AOV} as avg_order_value
        from tx group by month""",
    ),
    "bi_high_value_customers": (
        ["seg", "shoppers"],
        HIGH_VALUE.format(spend="monetary", tiers=quoted(HIGH_VALUE_TIERS)),
    ),
    "bi_raw_customers": (["shoppers"], "select * from shoppers"),
    "bi_raw_transactions": (
        ["tx"],
        f"""
        select transaction_id, customer_id, strftime(day, '%Y-%m-%d') as transaction_date, category,
               {money('price_cents')} as product_amount, quantity, discount_pct, {money('cents')} as final_amount,
               payment_mode, returned
        from tx""",
    ),
    "bi_raw_rfm": (
        ["seg"],
        """
        select customer_id, recency, frequency, monetary, r_score as "R_score", f_score as "F_score",
               m_score as "M_score", rfm_score as "RFM_score", cluster, segment
        from seg""",
    ),
    "pk_check": (
        ["tx", "shoppers", "seg"],
        " union all ".join(
            [
                _pk("shoppers", "customer_id", "customers"),
                _pk("tx", "transaction_id", "transactions"),
                _pk("seg", "customer_id", "rfm_segments"),
            ]
        ),
    ),
    "fk_check": (["tx", "shoppers", "seg"], _fk("tx", "transactions") + " union all " + _fk("seg", "rfm_segments")),
    "column_profile": (["tx"], PROFILE),
    "sample_customers": (
        ["shoppers"],
        f"""
        select customer_id from shoppers
        qualify row_number() over (order by md5(cast(customer_id as varchar)), customer_id)
                <= floor((select count(*) from shoppers) * {HIGH_VALUE_SHARE})""",
    ),
    "date_spine_revenue": (
        ["tx", "months"],
        f"""
        select strftime(spine.start, '%Y-%m') as month, coalesce({money('cents')}, 0) as revenue
        from (select unnest(generate_series(cast(date_trunc('month', min(day)) as timestamp),
                                            cast(max(day) as timestamp), interval 1 month)) as start from tx) spine
        left join months on months.month = strftime(spine.start, '%Y-%m')""",
    ),
    "weighted_bucket": (
        ["shoppers"],
        f"""
        select customer_id, bucket, {_arm()} as arm
        from (select customer_id, cast(cast(('0x' || md5(cast(customer_id as varchar))[1:8]) as ubigint) % 10000
                                       as bigint) as bucket from shoppers)""",
    ),
    "skew_report": (
        ["spend"],
        f"""
        select cast(top_pct as bigint) as top_pct, count(*) as customers, {big('sum(orders)')} as orders,
               {REVENUE} as revenue,
               {pct('sum(orders)', '(select sum(orders) from spend)')} as orders_pct,
               {pct('sum(cents)', '(select sum(cents) from spend)')} as revenue_pct
        from spend join (values {', '.join(f'({top})' for top in TOP_SHARES)}) as tops(top_pct)
          on place <= (everyone * top_pct + 99) // 100
        group by top_pct""",
    ),
    "domain_check": (["tx", "shoppers"], DOMAIN_RULES),
    "net_amount": (
        ["tx"],
        """
        select transaction_id,
               cast((price_cents * quantity * (100 - discount_pct) + 50) // 100 as double) / 100.0 as net_amount
        from tx""",
    ),
}

def _with_needs(names: list[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for needed in [*_with_needs(TABLES[name][0]), name]:
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def oracle_text(key: str) -> str:
    needs, body = TEXTS[key]
    tables = [f"{name} as materialized ({TABLES[name][1]})" for name in _with_needs(needs)]
    # a text with its own WITH clause, or UNPIVOT, is wrapped so that the shared tables can precede it
    return f"with {', '.join(tables)} select * from ({body})"


ORACLE_SQL = {key: oracle_text(key) for key in TEXTS}
