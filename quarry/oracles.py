"""DuckDB twins of the registered queries (tables are pre-registered views).

Each statement is written from the operator's definition, not from the Spark code: the
profile rules, the filter defaults and the chart shapes are restated in SQL. Rounding
and tie-breaking match the Spark side (see :mod:`quarry.queries`).
"""

from __future__ import annotations

from itertools import combinations

from quarry.functions.tokens import BOOLEAN_WORDS
from quarry.queries import KPI_FORMATTED, KPI_SCALARS

_WORDS = ", ".join(f"'{w}'" for w in BOOLEAN_WORDS)
_NUM_RE = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
_ISO_DATE_RE = r"\d{4}-\d{2}-\d{2}"
_ISO_TS_RE = r"\d{4}-\d{2}-\d{2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
_SLASH_DATE_RE = r"\d{1,2}/\d{1,2}/\d{4}"
_SLASH_TS_RE = r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?"


def _text_type(c: str) -> str:
    t = f"trim({c})"
    lw = f"lower(trim({c}))"
    date_ok = (
        f"((regexp_full_match({t}, '{_ISO_DATE_RE}') or regexp_full_match({t}, '{_ISO_TS_RE}')) "
        f"and try_cast(replace({t}, 'T', ' ') as timestamp) is not null) "
        f"or (regexp_full_match({t}, '{_SLASH_DATE_RE}') and try_strptime({t}, '%m/%d/%Y') is not null) "
        f"or (regexp_full_match({t}, '{_SLASH_TS_RE}') and coalesce(try_strptime({t}, '%m/%d/%Y %H:%M'), "
        f"try_strptime({t}, '%m/%d/%Y %H:%M:%S')) is not null)"
    )
    stripped = f"replace(replace(replace(replace({c}, ',', ''), '$', ''), '%', ''), ' ', '')"
    return (
        f"case when count({c}) = 0 then 'empty' "
        f"when bool_and({lw} in ({_WORDS})) and count(distinct case when {lw} in ({_WORDS}) then {lw} end) <= 3 "
        f"then 'boolean' "
        f"when bool_and({date_ok}) then 'datetime' "
        f"when bool_and(regexp_full_match({stripped}, '{_NUM_RE}')) then 'numeric_string' "
        f"when count(distinct {c}) / count({c}) < 0.5 and avg(length({c})) < 50 then 'categorical' "
        f"else 'text' end"
    )


def _type_expr(c: str, kind: str) -> str:
    if kind == "int":
        return f"case when count({c}) = 0 then 'empty' else 'integer' end"
    if kind == "float":
        return (f"case when count({c}) = 0 then 'empty' when bool_or(isinf({c})) then 'unknown' "
                f"when bool_and({c} = floor({c})) then 'integer' else 'float' end")
    if kind == "time":
        return f"case when count({c}) = 0 then 'empty' else 'datetime' end"
    if kind == "bool":
        return f"case when count({c}) = 0 then 'empty' else 'boolean' end"
    return _text_type(c)


def profile_sql(src: str, cols: list[tuple[str, str]], tbl: str | None = None) -> str:
    """One row per column of ``src`` (a view name or a parenthesised query)."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        typ = _type_expr(c, kind)
        rng = "cast(null as double)"
        rmin = rmax = rng
        if kind in ("int", "float"):
            rmin = f"case when ({typ}) in ('integer', 'float') then cast(min({c}) as double) end"
            rmax = f"case when ({typ}) in ('integer', 'float') then cast(max({c}) as double) end"
        top = "cast(null as varchar)"
        if kind == "text":
            top = (
                f"case when ({typ}) = 'categorical' then (select string_agg(v, ',' order by cnt desc, v) from "
                f"(select cast({c} as varchar) as v, count(*) as cnt from {src} s where {c} is not null "
                f"group by 1 order by cnt desc, v limit 3)) end"
            )
        head = f"'{tbl}' as tbl, " if tbl else ""
        parts.append(
            f"select {head}{i} as position, '{c}' as name, {typ} as type, "
            f"count(*) - count({c}) as nulls, round((count(*) - count({c})) / count(*) * 100, 9) as null_pct, "
            f"count(distinct {c}) as \"unique\", "
            f"case when count(distinct {c}) <= 10 then 'low' when count(distinct {c}) <= 100 then 'medium' "
            f"else 'high' end as cardinality, "
            f"{rmin} as range_min, {rmax} as range_max, {top} as top_values from {src} t"
        )
    return "\nunion all\n".join(parts)


EVENTS_COLS = [("event_id", "int"), ("ts", "time"), ("user_id", "int"), ("event_type", "text"),
               ("value", "float"), ("props", "text")]
LINEITEM_COLS = [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"),
                 ("l_tax", "float"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")]
DOCUMENTS_COLS = [("doc_id", "int"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "int")]
CONVERSATIONS_COLS = [("conv_id", "int"), ("turn", "int"), ("role", "text"), ("text", "text")]
PAGES_COLS = [("page_id", "int"), ("url", "text"), ("html", "text")]
CUSTOMER_COLS = [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "text")]
ORDERS_COLS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "float"), ("o_orderdate", "time"), ("o_orderpriority", "text")]
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]

CUSTOMER_NULLS = """(select c_custkey,
  case when c_custkey % 9 = 0 then null else c_name end as c_name,
  c_nationkey,
  case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal,
  case when c_custkey % 10 = 0 then null else c_mktsegment end as c_mktsegment,
  cast(null as varchar) as c_comment,
  case when c_custkey % 2 = 0 then 'yes' else 'no' end as c_active
  from customer)"""
CUSTOMER_NULLS_COLS = [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "float"),
                       ("c_mktsegment", "text"), ("c_comment", "text"), ("c_active", "text")]


def _corr_sql() -> str:
    parts = []
    for a, b in combinations(LINEITEM_NUMERIC, 2):
        for x, y in ((a, b), (b, a)):
            parts.append(f"select '{x}' as col_x, '{y}' as col_y, round(corr({a}, {b}), 9) as corr from lineitem")
    for a in LINEITEM_NUMERIC:
        parts.append(f"select '{a}' as col_x, '{a}' as col_y, case when stddev_pop({a}) > 0 then 1.0 end as corr "
                     f"from lineitem")
    return "\nunion all\n".join(parts)


def _kpi_scalars_sql() -> str:
    exprs = {
        "Total price": "sum(l_extendedprice)",
        "Mean quantity": "avg(l_quantity)",
        "Orders": "count(distinct l_orderkey)",
        "Price per line": "sum(l_extendedprice) / count(*)",
        "Gross": "coalesce(sum(l_quantity * l_extendedprice), 0)",
        "Top price": "max(l_extendedprice)",
        "Return share": "avg(case when l_returnflag = 'R' then 1.0 else 0.0 end)",
        "Discounted lines": "count(*) filter (where l_discount > 0.05)",
        "Tax spread": "stddev_samp(l_tax)",
        "Median quantity": "quantile_cont(l_quantity, 0.5)",
    }
    parts = []
    for rank, (name, _, dec) in enumerate(KPI_SCALARS, start=1):
        if name in exprs:
            parts.append(f"select {rank} as rank, '{name}' as name, round(cast({exprs[name]} as double), {dec}) "
                         f"as value, 'ok' as status from lineitem")
        else:
            parts.append(f"select {rank} as rank, '{name}' as name, cast(null as double) as value, "
                         f"'unsupported' as status")
    return "\nunion all\n".join(parts)


def _forms_sql(values: list) -> str:
    """KPI rows from scalar subqueries; a tuple holds one whose result is text."""
    rows = [
        f"select {i} as rank, cast(null as double) as value, cast({v[0]} as varchar) as text, 'ok' as status" if isinstance(v, tuple)
        else f"select {i} as rank, round(cast({v} as double), 4) as value, cast(null as varchar) as text, 'ok' as status"
        for i, v in enumerate(values, start=1)
    ]
    return "\nunion all ".join(rows)


def _fmt(v: str) -> str:
    return (
        f"case when abs({v}) >= 1000000000 then printf('%.1fB', {v} / 1000000000.0) "
        f"when abs({v}) >= 1000000 then printf('%.1fM', {v} / 1000000.0) "
        f"when abs({v}) >= 1000 then printf('%.1fK', {v} / 1000.0) "
        f"else format('{{:,.0f}}', {v}) end"
    )


def _kpi_formatted_sql() -> str:
    exprs = {
        "Balance": "sum(c_acctbal)",
        "Customers": "count(*)",
        "Mean balance": "avg(c_acctbal)",
        "Lowest balance": "min(c_acctbal)",
        "Nations": "count(distinct c_nationkey)",
        "Scaled": "count(*) * 1000000",
    }
    parts = []
    for rank, (name, _) in enumerate(KPI_FORMATTED, start=1):
        v = f"cast({exprs[name]} as double)"
        parts.append(f"select {rank} as rank, '{name}' as name, {_fmt(v)} as formatted from customer")
    return "\nunion all\n".join(parts)


def _top3(tbl: str, col: str) -> str:
    return (
        f"select '{tbl}' as tbl, '{col}' as name, cast(rk as integer) as rk, v, cnt from ("
        f"select cast({col} as varchar) as v, count(*) as cnt, "
        f"row_number() over (order by count(*) desc, cast({col} as varchar)) as rk "
        f"from {tbl} where {col} is not null group by 1) where rk <= 3"
    )


_EVENTS_FILTERED = """(select e.* from events e,
  (select cast(min(ts) as date) as lo, cast(max(ts) as date) as hi from events) b
  where cast(e.ts as date) between (case when b.hi - b.lo > 90 then b.hi - 90 else b.lo end) and b.hi
    and e.event_type in (select v from (select distinct event_type as v from events where event_type is not null)
                         order by v limit 5))"""


def _auto_dashboard_sql() -> str:
    f = _EVENTS_FILTERED
    return f"""
select 'Event_Id Trend' as panel, 'time_series' as kind, 1 as rank, cast(ts as varchar) as x,
       cast(null as varchar) as x2, round(cast(sum(event_id) as double), 9) as y, cast(null as double) as y2
from {f} t where ts is not null group by ts
union all
select * from (
  select 'Event_Id by Event_Type', 'bar', 2, event_type, null, round(cast(sum(event_id) as double), 9), null
  from {f} t where event_type is not null group by event_type
  order by sum(event_id) desc, event_type limit 10)
union all
select 'Event_Id Distribution', 'histogram', 3, cast(lo + bin * ((hi - lo) / 20) as varchar),
       cast(case when bin = 19 then hi else lo + (bin + 1) * ((hi - lo) / 20) end as varchar),
       round(cast(cnt as double), 9), null
from (
  select bin, lo, hi, count(*) as cnt from (
    select cast(least(floor((cast(event_id as double) - lo) / ((hi - lo) / 20)), 19) as integer) as bin, lo, hi
    from {f} t, (select cast(min(event_id) as double) as lo, cast(max(event_id) as double) as hi from {f} q) b
    where event_id is not null) group by bin, lo, hi)
union all
select 'Event_Id vs User_Id', 'scatter', 4, cast(event_id as varchar), null, round(cast(user_id as double), 9), null
from {f} t
"""


def _recommend_sql(table: str, cols: list[tuple[str, str]]) -> str:
    """U3 from the profile's types: the first columns of each role fill the items that need them."""
    title = "array_to_string(list_transform(string_split({0}, '_'), lambda w: upper(w[1]) || lower(w[2:])), '_')"
    n0, n1, d0, c0 = title.format("n[1]"), title.format("n[2]"), title.format("d[1]"), title.format("c[1]")
    items = [
        ("kpis", "len(n) > 0", f"'Total ' || {n0}", "kpi", "null", "null", "'df[''' || n[1] || '''].sum()'", 10),
        ("kpis", "len(n) > 1", f"'Average ' || {n1}", "kpi", "null", "null", "'df[''' || n[2] || '''].mean()'", 8),
        ("charts", "len(d) > 0 and len(n) > 0", f"{n0} || ' Trend'", "time_series", "d[1]", "n[1]", "null", 10),
        ("charts", "len(c) > 0 and len(n) > 0", f"{n0} || ' by ' || {c0}", "bar", "c[1]", "n[1]", "null", 9),
        ("charts", "len(n) > 0", f"{n0} || ' Distribution'", "histogram", "n[1]", "null", "null", 7),
        ("charts", "len(n) > 1", f"{n0} || ' vs ' || {n1}", "scatter", "n[1]", "n[2]", "null", 6),
        ("filters", "len(d) > 0", f"{d0} || ' Filter'", "date", "d[1]", "null", "null", 10),
        ("filters", "len(c) > 0", f"{c0} || ' Filter'", "multiselect", "c[1]", "null", "null", 8),
    ]
    rows = "\nunion all\n".join(
        f"select '{sec}' as section, {name} as name, '{typ}' as type, cast({x} as varchar) as x_column, cast({y} as varchar) as y_column, "
        f"cast({formula} as varchar) as formula, {imp} as importance from slots where {needs}"
        for sec, needs, name, typ, x, y, formula, imp in items
    )
    return f"""with prof as ({profile_sql(table, cols)}),
slots as (select list(name order by position) filter (type in ('integer', 'float', 'numeric_string')) as n,
  list(name order by position) filter (type = 'datetime') as d, list(name order by position) filter (type = 'categorical') as c from prof),
items as ({rows})
select *, cast(row_number() over (partition by section order by importance desc) as integer) as rank from items"""


ORACLES: dict[str, str] = {
    "bar_sum_top10": """select l_suppkey as x, round(sum(l_extendedprice), 2) as y from lineitem
        where l_suppkey is not null group by l_suppkey order by sum(l_extendedprice) desc, l_suppkey limit 10""",
    "bar_count_top10": """select p_brand as x, count(*) as y from part where p_brand is not null
        group by p_brand order by y desc, x limit 10""",
    "time_series_raw": """select o_orderdate as x, round(coalesce(sum(o_totalprice), 0), 2) as y from orders
        where o_orderdate is not null group by o_orderdate""",
    "time_series_day": """select cast(date_trunc('day', ts) as timestamp) as x, round(coalesce(sum(value), 0), 2) as y
        from events where ts is not null group by 1""",
    "histogram_20": """with b as (select cast(min(value) as double) as lo, cast(max(value) as double) as hi from events),
        h as (select cast(least(floor((value - lo) / ((hi - lo) / 20)), 19) as integer) as bin, count(*) as cnt
              from events, b where value is not null group by 1)
        select bin, round(lo + bin * ((hi - lo) / 20), 9) as bin_lo,
               round(case when bin = 19 then hi else lo + (bin + 1) * ((hi - lo) / 20) end, 9) as bin_hi,
               cnt as count from h, b""",
    "time_series_text_dates": """select o_orderdate as x, round(coalesce(sum(o_totalprice), 0), 2) as y
        from orders where o_orderdate is not null group by o_orderdate""",
    "histogram_text": """select c_mktsegment as x, count(*) as count from customer
        where c_mktsegment is not null group by 1""",
    "scatter_points": "select p_size as x, p_retailprice as y from part",
    "heatmap_corr": _corr_sql(),
    "pie_count_top8": """with t as (select p_type as x, count(*) as y from part where p_type is not null
        group by 1 order by y desc, x limit 8) select x, y, round(y / sum(y) over (), 9) as share from t""",
    "pie_sum_first8": """with t as (select c_nationkey as x, coalesce(sum(c_acctbal), 0) as y from customer
        where c_nationkey is not null group by 1 order by x limit 8)
        select x, round(y, 2) as y, round(y / sum(y) over (), 9) as share from t""",
    "funnel": """select event_type as x, round(coalesce(sum(value), 0), 2) as y from events
        where event_type is not null group by 1""",
    "preview": "select * from nation order by n_nationkey limit 5",
    "value_frequencies": "select p_name as x, count(*) as count from part where p_name is not null group by 1",
    "filter_date_last90": """select * from lineitem where cast(l_shipdate as date) between
        (select case when cast(max(l_shipdate) as date) - cast(min(l_shipdate) as date) > 90
                     then cast(max(l_shipdate) as date) - 90 else cast(min(l_shipdate) as date) end from lineitem)
        and (select cast(max(l_shipdate) as date) from lineitem)""",
    "filter_in_default5": """select * from orders where o_orderpriority in (
        select v from (select distinct o_orderpriority as v from orders where o_orderpriority is not null)
        order by v limit 5)""",
    "filter_in_top100": """select * from customer where c_name in (
        select c_name from (select c_name, count(*) as cnt from customer where c_name is not null group by 1
                            order by cnt desc, c_name limit 100)
        order by cnt desc, c_name limit 5)""",
    "filter_range_p1_p99": """select * from lineitem where l_extendedprice between
        (select quantile_cont(l_extendedprice, 0.01) from lineitem)
        and (select quantile_cont(l_extendedprice, 0.99) from lineitem)""",
    "filter_equals": """select * from events where event_type = (select event_type from events
        where event_type is not null group by 1 order by count(*) desc, event_type limit 1)""",
    "filters_user_selection": """select * from lineitem
        where cast(l_shipdate as date) between date '1997-01-01' and date '1998-06-30'
          and l_returnflag in ('A', 'R') and l_quantity between 10.0 and 30.0""",
    "filter_options_top50": """select p_name as x, count(*) as count from part where p_name is not null
        group by 1 order by count desc, x limit 50""",
    "filters_conjunction": """with b as (select cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi
                   from orders),
        s as (select case when hi - lo > 90 then hi - 90 else lo end as st, hi from b),
        p as (select quantile_cont(o_totalprice, 0.01) as p1, quantile_cont(o_totalprice, 0.99) as p99 from orders),
        o5 as (select v from (select distinct o_orderpriority as v from orders where o_orderpriority is not null)
               order by v limit 5)
        select orders.* from orders, s, p
        where cast(o_orderdate as date) between s.st and s.hi
          and o_orderpriority in (select v from o5)
          and o_totalprice between p.p1 and p.p99""",
    "kpi_scalars": _kpi_scalars_sql(),
    "kpi_grouped": """select 'Balance by segment' as name, cast(c_mktsegment as varchar) as key,
        round(cast(coalesce(sum(c_acctbal), 0) as double), 2) as value
        from customer where c_mktsegment is not null group by c_mktsegment""",
    "kpi_grouped_median": """select 'Median balance' as name, cast(c_mktsegment as varchar) as key,
        round(median(c_acctbal), 6) as value from customer
        where c_mktsegment is not null and c_acctbal is not null group by c_mktsegment""",
    "kpi_formatted": _kpi_formatted_sql(),
    "plan_kpis": """select 1 as rank, 'Total Sales' as name, null as key, round(sum(o_totalprice), 2) as value, 'ok' as status
        from orders
        union all select 2, 'Average Order Value', null, round(avg(o_totalprice), 2), 'ok' from orders
        union all select 3, 'Sales by Status', null, cast(null as double), 'grouped'
        union all (select null, 'Sales by Status', o_orderstatus, round(sum(o_totalprice), 2), 'group' from orders
          where o_orderstatus is not null group by o_orderstatus)""",
    "derived_convention": """select l_orderkey, l_linenumber, l_quantity as quantity, l_extendedprice as unitprice,
        round(l_quantity * l_extendedprice, 2) as total_sales, round(l_quantity * l_extendedprice, 2) as revenue
        from lineitem""",
    "derived_product": """select l_orderkey, l_linenumber,
        round(l_quantity * l_extendedprice, 2) as l_quantity_l_extendedprice_product,
        round(l_quantity * l_extendedprice, 2) as l_quantity_x_l_extendedprice from lineitem""",
    "profile_events": profile_sql("events", EVENTS_COLS),
    "profile_lineitem": profile_sql("lineitem", LINEITEM_COLS),
    "profile_customer_nulls": profile_sql(CUSTOMER_NULLS, CUSTOMER_NULLS_COLS),
    "profile_documents": profile_sql("documents", DOCUMENTS_COLS),
    "profile_conversations": profile_sql("conversations", CONVERSATIONS_COLS),
    "profile_pages": profile_sql("pages", PAGES_COLS),
    "profile_top3": "\nunion all\n".join([
        _top3("orders", "o_orderstatus"), _top3("orders", "o_orderpriority"), _top3("customer", "c_mktsegment")]),
    "profile_sample3": """select cast(c_custkey as varchar) as c_custkey, coalesce(c_name, '') as c_name,
        cast(c_nationkey as varchar) as c_nationkey, cast(c_acctbal as varchar) as c_acctbal,
        coalesce(c_mktsegment, '') as c_mktsegment
        from (select * from customer order by c_custkey limit 3) s""",
    "csv_roundtrip": "select * from events",
    "csv_bad_rows": """select event_id, ts, user_id, event_type,
        case when event_id % 100 = 1 then null else value end as value,
        case when event_id % 100 = 1 then null else props end as props from events where event_id % 100 <> 0""",
    "csv_rejects": """select concat_ws(',', event_id, cast(ts as varchar), user_id, event_type, value, props, 'x') as line,
        6 as expected, 7 as found from events where event_id % 100 = 0""",
    "csv_strict": "select * from events where event_id % 100 > 1",
    "csv_quotes": "select * from events",
    "reload_with_fallback": """select orders.*, load, case load when 'whole' then 'manifest' else 'ingest' end as by,
        (select count(*) from orders) as rows, ',' as sep from orders, (select unnest(['whole', 'torn']) as load)""",
    "csv_documents": "select * from documents",
    "csv_long_ids": """select o_orderkey + 1234567890123456789 as id,
        cast(o_orderkey + 1234567890123456789000 as decimal(38, 0)) as wide from orders""",
    "csv_many_headers": """select case when c_custkey = 10 then 'key' else cast(c_custkey as varchar) end as key,
        case when c_custkey = 10 then 'name' else c_name end as name from customer""",
    "csv_reject_lines": """select part, line_number, expected, found from (
        select event_id, event_id % 8 as part, row_number() over (partition by event_id % 8 order by event_id) + 1 as line_number,
          6 as expected, case event_id % 100 when 0 then 7 when 1 then 2 else 6 end as found from events)
        where event_id % 100 < 2""",
    "csv_headers_by_name": """select o_orderkey, o_orderstatus, o_totalprice, o_orderdate,
        case when o_orderkey % 2 = 1 then o_custkey end as o_custkey from orders""",
    "csv_line_breaks": r"""select cast(doc_id as varchar) as doc_id, text, lang, source, cast(n_chars as varchar) as n_chars,
        (select coalesce(sum(length(text) - length(replace(text, chr(10), '')) + 1), 0)::bigint from documents where contains(text, chr(10))) as rejected
        from documents where not coalesce(contains(text, chr(10)), false)""",
    "csv_tokens": """select c_custkey, case when c_custkey % 2 = 0 then null else c_mktsegment end as c_mktsegment
        from customer""",
    "plan_roundtrip": _recommend_sql("orders", ORDERS_COLS),
    "metadata_roundtrip": """select ',' as delimiter, 'utf-8' as encoding, count_if(event_id % 100 <> 0) as rows,
        cast(6 as bigint) as columns, count_if(event_id % 100 = 0) as rejects from events""",
    "bar_sum_wide": """select l_returnflag as x, cast(sum(cast(l_partkey as hugeint) + 4000000000000000000) as varchar) as y
        from lineitem group by 1""",
    "kpi_sum_wide": """select 'Big' as name, cast(sum(cast(l_partkey as hugeint) + 4000000000000000000) as double) as value,
        'ok' as status from lineitem""",
    "kpi_product_wide": """with li as (select cast(l_partkey as hugeint) + 4000000000000000000 as big, l_linenumber as n from lineitem),
        p as (select cast(1900000000 + p_partkey % 100000000 as hugeint) as wide, cast(p_size * 1000000 as hugeint) as size from part)
        select name, printf('%.6e', value) as value, 'ok' as status from (
        select '(df[''big''] + df[''big'']).sum()' as name, cast(sum(big + big) as double) as value from li
        union all select '(df[''big''] * df[''l_linenumber'']).max()', cast(max(big * n) as double) from li
        union all select '(df[''big''] * df[''big'']).mean()', avg(cast(big as double) * big) from li
        union all select '(df[''big''] * df[''big'']).sum()', sum(cast(big as double) * big) from li
        union all select '(df[''wide''] * df[''size'']).sum()', cast(sum(wide * size) as double) from p
        union all select '(df[''wide''] * 1000 - df[''size''] * df[''wide''] * 7).min()', cast(min(wide * 1000 - size * wide * 7) as double) from p
        union all select '(-df[''wide''] * df[''wide'']).mean()', avg(cast(-wide * wide as double)) from p)""",
    "kpi_nested": """select 1 as rank, 'Mean per customer' as name, round((select avg(s) from
          (select sum(o_totalprice) as s from orders where o_custkey is not null group by o_custkey)), 2) as value, 'ok' as status
        union all select 2, 'Largest status', (select max(n) from (select count(*) as n from orders
          where o_orderstatus is not null group by o_orderstatus)), 'ok'""",
    "kpi_running": _forms_sql([
        "(select sum(o_custkey) from orders)", "(select avg(d) from (select o_totalprice - lag(o_totalprice) over (order by o_orderkey) as d from orders))",
        "(select max(d) from (select o_totalprice / nullif(lag(o_totalprice) over (order by o_orderkey), 0) - 1 as d from orders))",
        "(select max(m) from (select case when count(*) over w = 7 then avg(o_totalprice) over w end as m from orders window w as (order by o_orderkey rows 6 preceding)))",
        "(select min(m) from (select case when count(*) over w = 30 then sum(o_totalprice) over w end as m from orders where o_orderstatus = 'F' window w as (order by o_orderkey rows 29 preceding)))",
        "(select sum(s) from (select lag(o_custkey, 3) over (order by o_orderkey) as s from orders))",
        "(select avg(m) from (select max(o_totalprice) over (order by o_orderkey rows unbounded preceding) as m from orders))",
    ]),
    "kpi_best": _forms_sql([
        ("(select o_orderpriority from orders where o_totalprice is not null order by o_totalprice desc, o_orderpriority limit 1)",),
        "(select o_orderkey from orders where o_totalprice is not null order by o_totalprice, o_orderkey limit 1)",
        "(select sum(o_totalprice) from (select o_totalprice from orders order by o_totalprice desc nulls last limit 10))",
        "(select avg(o_totalprice) from (select o_totalprice from orders order by o_totalprice nulls last limit 25))",
        ("(select o_orderstatus from orders where o_orderstatus is not null group by 1 order by count(*) desc, 1 limit 1)",),
        "(select o_custkey from orders where o_custkey is not null group by 1 order by count(*) desc, 1 limit 1)",
        "(select max(n) from (select count(*) as n from orders where o_orderpriority is not null group by o_orderpriority))",
        ("(select o_orderpriority from orders where o_orderpriority is not null group by 1 order by sum(o_totalprice) desc, 1 limit 1)",),
        "(select o_custkey from orders where o_custkey is not null group by 1 order by avg(o_totalprice), 1 limit 1)",
    ]),
    "kpi_group_keys": """with m as (select date_trunc('month', l_shipdate)::timestamp as p, sum(l_extendedprice) as v from lineitem where l_quantity > 49 group by 1),
        s as (select date_trunc('day', l_shipdate)::timestamp as p, count(*) as v from lineitem where l_suppkey = 7 group by 1)
        select name, key, round(value::double, 2) as value from (
        select '0' as name, l_returnflag || ', ' || l_linestatus as key, coalesce(sum(l_quantity), 0)::double as value from lineitem where l_returnflag is not null and l_linestatus is not null group by 2
        union all select '1', month(l_shipdate)::varchar, avg(l_extendedprice) from lineitem where l_shipdate is not null group by 2
        union all select '2', l_linenumber::varchar, count(*) from lineitem where l_linenumber is not null group by 2
        union all select '3', l_returnflag, max(l_tax) from lineitem where l_returnflag is not null group by 2
        union all select '4', strftime(last_day(g), '%Y-%m-%d'), coalesce(v, 0) from (select unnest(generate_series((select min(p) from m), (select max(p) from m), interval 1 month)) as g) left join m on p = g
        union all select '5', strftime(g, '%Y-%m-%d'), coalesce(v, 0) from (select unnest(generate_series((select min(p) from s), (select max(p) from s), interval 1 day)) as g) left join s on p = g)""",
    "kpi_typed": _forms_sql([
        "(select count(distinct year(o_orderdate)) from orders)", "(select avg(case when isodow(o_orderdate) >= 6 then 1.0 else 0.0 end) from orders)",
        "(select floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400) from orders)", "(select count_if(contains(o_orderpriority, 'URGENT')) from orders)", "(select count_if(starts_with(o_orderpriority, '1')) from orders)",
        "(select coalesce(sum(case when o_totalprice > 100000 then o_totalprice else 0 end), 0) from orders)", "(select coalesce(sum(trunc(o_totalprice)), 0) from orders)",
    ]) + " union all select rank + 100, value, text, status from (" + _forms_sql([
        "(select max(length(text)) from documents)", "(select count(distinct upper(source)) from documents)", "(select coalesce(sum(abs(length(text) - n_chars)), 0) from documents)",
        "(select avg(case when coalesce(regexp_matches(text, '(?i)the'), false) then 1.0 else 0.0 end) from documents)",
    ]) + ")",
    "kpi_first": _forms_sql([
        "(select count(*) - count(distinct l_suppkey) - max(case when l_suppkey is null then 1 else 0 end) from lineitem)",
        "(select count(*) - (select count(*) from (select distinct l_orderkey, l_suppkey from lineitem)) from lineitem)",
        "(select sum(l_quantity) from (select l_quantity from lineitem qualify row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag) = 1))",
        "(select max(l_quantity) from (select l_quantity from lineitem qualify row_number() over (partition by l_returnflag, l_linenumber order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag) = 1))",
        "(select count(*) from (select distinct l_returnflag from lineitem))",
        "(select count(*) from (select distinct l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag from lineitem))",
    ]),
    "kpi_moments": _forms_sql([
        "(select corr(l_quantity, l_extendedprice) from lineitem)", "(select covar_samp(l_quantity, l_tax) from lineitem)", "(select skewness(l_extendedprice) from lineitem)",
        "(select kurtosis(l_extendedprice) from lineitem)", "(select 1)", "(select stddev_samp(l_tax) / sqrt(count(l_tax)) from lineitem)",
        "(select quantile_cont(l_extendedprice, 0.9) from lineitem)", "(select quantile_cont(l_extendedprice, 0.25) from lineitem)", "(select median(l_quantity) from lineitem)",
    ]),
    "kpi_masks": """select rank, round(cast(value as double), 2) as value, 'ok' as status from (
        select 1 as rank, count_if(o_orderstatus in ('F', 'P'))::double as value from orders
        union all select 2, coalesce(sum(o_totalprice) filter (o_totalprice between 1000 and 50000), 0) from orders
        union all select 3, count_if(o_orderpriority is null) from orders
        union all select 4, count(distinct o_custkey) from orders
        union all select 5, quantile_cont(o_totalprice, 0.9) from orders
        union all select 6, count(distinct o_orderpriority) + cast(coalesce(bool_or(o_orderpriority is null), false) as int) from orders
        union all select 7, round_even(avg(o_totalprice), 1) from orders
        union all select 8, min(coalesce(o_totalprice, 0)) from orders)""",
    "derived_int_product": """select p_partkey,
        cast(cast(1900000000 + p_partkey % 100000000 as hugeint) * (p_size * 1000000) as varchar) as total_sales from part""",
    "plan_text_numbers": """select 'Total' as name, null as x, round(sum(o_totalprice), 2) as y from orders
        union all (select 'By priority', o_orderpriority, round(sum(o_totalprice), 2) from orders group by 2)""",
    "profile_nan": profile_sql("(select event_id, ts, user_id, event_type, case when event_id % 7 = 0 then null else value end as value, props from events)", EVENTS_COLS),
    "profile_infinite": """select 'event_id' as name, 'integer' as type, 0 as nulls union all
        select 'value', 'unknown', count(*) - count(value) from events where event_id <> 5 or value is not null""",
    "histogram_nan": """with e as (select value from events where event_id % 7 <> 0),
        b as (select cast(min(value) as double) as lo, cast(max(value) as double) as hi from e),
        h as (select cast(least(floor((value - lo) / ((hi - lo) / 20)), 19) as integer) as bin, count(*) as cnt
              from e, b where value is not null group by 1)
        select bin, round(lo + bin * ((hi - lo) / 20), 9) as bin_lo,
               round(case when bin = 19 then hi else lo + (bin + 1) * ((hi - lo) / 20) end, 9) as bin_hi,
               cnt as count from h, b""",
    "filter_range_nan": """with e as (select * from events where event_id % 7 <> 0)
        select * from e where value between (select quantile_cont(value, 0.01) from e) and (select quantile_cont(value, 0.99) from e)""",
    "promote_dates_forms": """select o_orderkey, o_orderdate as zulu, o_orderdate as "offset", o_orderdate as slashes, o_orderdate as dashes,
        o_orderdate as words, o_orderdate as day_first, o_orderdate as short, o_orderdate as noon from orders""",
    "promote_dates_dayfirst": "select o_orderkey, o_orderdate as day, o_orderdate as timed, o_orderdate as month from orders",
    "promote_dates_lenient": """select o_orderkey, case when o_orderkey % 50 = 0 then null else o_orderdate end as d,
        (select count(*) from orders where o_orderkey % 50 = 0) as failures from orders""",
    "csv_latin1": "select doc_id, text from documents",
    "normalize_names": """select c_custkey as ccustkey, c_name as cname, c_nationkey as cnationkey, c_acctbal as cacctbal,
        c_mktsegment as cmktsegment from customer""",
    "promote_dates": "select o_orderkey, o_orderdate from orders",
    "promote_numbers": """select c_custkey, case when c_custkey % 10 = 0 then null else c_acctbal end as c_acctbal,
        cast(c_nationkey as bigint) as c_nationkey, c_name from customer""",
    "drop_empty_rows": "select * from customer where c_custkey % 7 <> 0",
    "drop_empty_columns": """select c_custkey, case when c_custkey % 9 = 0 then null else c_name end as c_name,
        c_nationkey, case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal,
        case when c_custkey % 10 = 0 then null else c_mktsegment end as c_mktsegment,
        case when c_custkey % 2 = 0 then 'yes' else 'no' end as c_active from customer""",
    "majority_numeric": """select p_partkey,
        case when p_partkey % 5 = 0 then 0.0 else cast(p_partkey as double) end as p_code, p_brand from part""",
    "display_text": """select o_orderkey,
        case when o_orderkey % 11 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as o_orderdate,
        case when o_orderkey % 5 in (0, 1, 2) then '' else o_orderpriority end as o_orderpriority,
        case when o_orderkey % 3 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' end as ship_date
        from orders""",
    "export_filtered": """select l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
        from lineitem where l_returnflag = 'R'""",
    "empty_input": "select 0::bigint as rows, count(*) as kept from customer where c_acctbal > 1e12",
    "spec_roundtrip": profile_sql("customer", CUSTOMER_COLS),
    "reload_clean": "select * from orders",
    "recommend_plan": _recommend_sql("events", EVENTS_COLS),
    "auto_dashboard": _auto_dashboard_sql(),
}
