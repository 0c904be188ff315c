"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code paths: line-level aggregates are
taken straight from the lines, modes and first values by ranked
subqueries.  The binding (sources/binding.py) is inlined as CTEs so the
text runs against the raw test tables.
"""

from __future__ import annotations

from ..functions.scalar import PAYMENT_MAPPING
from ..sources.binding import BINDING_CTES


def payment_case(col: str = "PAYMENT_METHOD") -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in PAYMENT_MAPPING.items())
    return f"case {col} {whens} end"


CLEANED = f"""
select od.* replace ({payment_case('od.PAYMENT_METHOD')} as PAYMENT_METHOD),
  sm.STORE_NAME, sm.PREFIX, pm.SKU_NAME, coalesce(pm.SKU_CATEGORY, 'Unknown') as SKU_CATEGORY,
  pm.SKU_SUBCATEGORY, coalesce(pm.SKU_IS_BUNDLE, 0) as SKU_IS_BUNDLE,
  od.UNIT_LIST_PRICE - od.UNIT_OFFERED_PRICE as UNIT_ORGANIC_DISCOUNT,
  od.UNIT_OFFERED_PRICE - od.UNIT_CHARGED_PRICE as UNIT_EXTRA_DISCOUNT,
  (od.UNIT_LIST_PRICE - od.UNIT_OFFERED_PRICE) * od.UNIT_QUANTITY as UNIT_TOTAL_ORGANIC_DISCOUNT,
  (od.UNIT_OFFERED_PRICE - od.UNIT_CHARGED_PRICE) * od.UNIT_QUANTITY as UNIT_TOTAL_EXTRA_DISCOUNT,
  (od.UNIT_LIST_PRICE - od.UNIT_OFFERED_PRICE) * od.UNIT_QUANTITY
    + (od.UNIT_OFFERED_PRICE - od.UNIT_CHARGED_PRICE) * od.UNIT_QUANTITY as UNIT_TOTAL_DISCOUNTS
from order_details od
left join store_master sm on od.STORE_ID = sm.STORE_ID
left join product_master pm on od.SKU_ID = pm.SKU_ID
where sm.STORE_NAME is not null
  and not coalesce(od.ORDER_STATE_FINAL in ('Fraud'), false)
  and pm.SKU_NAME is not null"""

VALID = "select * from cleaned where ORDER_STATE_FINAL = 'Valid'"

FIRSTS = """
select CUSTOMER_ID, ORDER_ID, STORE_NAME as STORE, PREFIX as STORE_TYPE, PAYMENT_METHOD from (
  select *, row_number() over (partition by CUSTOMER_ID, ORDER_ID
      order by LINE_NO, SKU_ID, STORE_ID, STORE_NAME, PREFIX, PAYMENT_METHOD nulls first) as rn
  from valid where CUSTOMER_ID is not null) t
where rn = 1 and ORDER_ID is not null"""

OPS_WITH_CUSTOMER = """
select o.*, p.CUSTOMER_ID, dayname(o.ORDER_DATE) as WEEKDAY,
  hour(try_strptime(o.ORDER_TIME, '%H:%M:%S')) as HOUR
from operation_details o
left join (select distinct ORDER_ID, CUSTOMER_ID from cleaned) p on o.ORDER_ID = p.ORDER_ID"""

VALID_OPS = "select * from opc where ORDER_STATE_FINAL = 'Valid' and CUSTOMER_ID is not null"


def dsum(x: str) -> str:
    """Exact DECIMAL sum, 0 for an all-NULL group (twin of nulls.exact_sum)."""
    return f"coalesce(sum(cast({x} as decimal(38,6))), 0)"


def davg(x: str) -> str:
    """Exact mean (twin of nulls.exact_avg)."""
    return f"cast(sum(cast({x} as decimal(38,6))) as double) / cast(count({x}) as double)"


def mode_cte(src: str, col: str, key: str = "CUSTOMER_ID") -> str:
    """Most frequent non-NULL ``col`` per key; ties -> smallest value."""
    return f"""
select {key}, v from (
  select {key}, v, row_number() over (partition by {key} order by n desc, v asc) as rn from (
    select {key}, {col} as v, count(*) as n from {src}
    where {key} is not null and {col} is not null group by {key}, {col}) c) r
where rn = 1"""


def base_ctes() -> dict[str, str]:
    ctes = dict(BINDING_CTES)
    ctes["cleaned"] = CLEANED
    ctes["valid"] = VALID
    return ctes


def feature_ctes() -> dict[str, str]:
    ctes = base_ctes()
    ctes["refd"] = "select max(ORDER_DATE) as d from cleaned"
    ctes["rfm"] = f"""
select CUSTOMER_ID,
  cast(floor((epoch(max(refd.d)) - epoch(max(ORDER_DATE))) / 86400) as bigint) as Recency,
  count(distinct ORDER_ID) as Frequency,
  cast({dsum('UNIT_NET')} as double) as Monetary,
  cast({dsum('UNIT_QUANTITY')} as double) as Total_Units,
  cast({dsum('UNIT_TOTAL_ORGANIC_DISCOUNT')} as double) as Total_Organic_Discount,
  cast({dsum('UNIT_TOTAL_EXTRA_DISCOUNT')} as double) as Total_Extra_Discount,
  cast({dsum('UNIT_TOTAL_DISCOUNTS')} as double) as Total_Discounts
from valid, refd where CUSTOMER_ID is not null group by CUSTOMER_ID"""
    ctes["ol"] = f"""
select CUSTOMER_ID, ORDER_ID,
  {dsum('UNIT_TOTAL_ORGANIC_DISCOUNT')} as o_org,
  {dsum('UNIT_TOTAL_EXTRA_DISCOUNT')} as o_ext,
  {dsum('UNIT_TOTAL_DISCOUNTS')} as o_tot,
  {dsum('UNIT_QUANTITY')} as o_qty,
  coalesce(bool_or(coalesce(SKU_IS_BUNDLE = 1, false)), false) as o_bundle
from valid where CUSTOMER_ID is not null and ORDER_ID is not null group by CUSTOMER_ID, ORDER_ID"""
    ctes["beh"] = f"""
select CUSTOMER_ID,
  {davg('o_org')} as AVG_ORGANIC_DISCOUNT_PER_ORDER, {davg('cast(o_org > 0 as bigint)')} as USED_ORGANIC_DISCOUNT_RATIO,
  {davg('o_ext')} as AVG_EXTRA_DISCOUNT_PER_ORDER, {davg('cast(o_ext > 0 as bigint)')} as USED_EXTRA_DISCOUNT_RATIO,
  {davg('o_tot')} as AVG_TOTAL_DISCOUNT_PER_ORDER, {davg('cast(o_tot > 0 as bigint)')} as USED_TOTAL_DISCOUNT_RATIO,
  {davg('o_qty')} as AVG_UNIT_QUANTITY_PER_ORDER, {davg('cast(o_qty > 2 as bigint)')} as IS_BULK_BUYER,
  {davg('cast(o_bundle as integer)')} as BUNDLE_PURCHASE_RATIO
from ol group by CUSTOMER_ID"""
    ctes["firsts"] = FIRSTS
    ctes["f_store"] = mode_cte("firsts", "STORE")
    ctes["f_type"] = mode_cte("firsts", "STORE_TYPE")
    ctes["f_pay"] = mode_cte("firsts", "PAYMENT_METHOD")
    ctes["cat"] = """
select CUSTOMER_ID, count(distinct SKU_CATEGORY) as CATEGORY_DIVERSITY,
  count(distinct SKU_SUBCATEGORY) as SUB_CATEGORY_DIVERSITY
from valid where CUSTOMER_ID is not null group by CUSTOMER_ID"""
    ctes["f_cat"] = mode_cte("valid", "SKU_CATEGORY")
    ctes["f_sub"] = mode_cte("valid", "SKU_SUBCATEGORY")
    ctes["opc"] = OPS_WITH_CUSTOMER
    ctes["vops"] = VALID_OPS
    ctes["opsf"] = f"""
select CUSTOMER_ID, {davg('DELIVERY_TIME')} as AVG_DELIVERY_TIME,
  cast(count_if(coalesce(WITHIN_SLA = 0, false)) as double) / cast(count(*) as double) as SLA_VIOLATION_RATE,
  {davg('APPROVAL_TIME')} as AVG_APPROVAL_TIME, {davg('TOTAL_DISTANCE')} as AVG_TOTAL_DISTANCE
from vops group by CUSTOMER_ID"""
    ctes["f_wd"] = mode_cte("vops", "WEEKDAY")
    ctes["f_hr"] = mode_cte("vops", "HOUR")
    ctes["features"] = """
select r.CUSTOMER_ID, r.Recency, r.Frequency, r.Monetary, r.Total_Units, r.Total_Organic_Discount,
  r.Total_Extra_Discount, r.Total_Discounts,
  b.AVG_ORGANIC_DISCOUNT_PER_ORDER, b.USED_ORGANIC_DISCOUNT_RATIO, b.AVG_EXTRA_DISCOUNT_PER_ORDER,
  b.USED_EXTRA_DISCOUNT_RATIO, b.AVG_TOTAL_DISCOUNT_PER_ORDER, b.USED_TOTAL_DISCOUNT_RATIO,
  b.AVG_UNIT_QUANTITY_PER_ORDER, b.IS_BULK_BUYER, b.BUNDLE_PURCHASE_RATIO,
  case when b.CUSTOMER_ID is not null then coalesce(fs.v, 'Unknown') end as FAVOURITE_STORE,
  case when b.CUSTOMER_ID is not null then coalesce(ft.v, 'Unknown') end as FAVOURITE_STORE_TYPE,
  case when b.CUSTOMER_ID is not null then coalesce(fp.v, 'Unknown') end as FAVOURITE_PAYMENT_METHOD,
  case when b.CUSTOMER_ID is not null then c.CATEGORY_DIVERSITY end as CATEGORY_DIVERSITY,
  case when b.CUSTOMER_ID is not null then coalesce(fc.v, 'Unknown') end as FAVORITE_CATEGORY,
  case when b.CUSTOMER_ID is not null then c.SUB_CATEGORY_DIVERSITY end as SUB_CATEGORY_DIVERSITY,
  case when b.CUSTOMER_ID is not null then coalesce(fsc.v, 'Unknown') end as FAVORITE_SUB_CATEGORY,
  o.AVG_DELIVERY_TIME, o.SLA_VIOLATION_RATE, o.AVG_APPROVAL_TIME, o.AVG_TOTAL_DISTANCE,
  case when o.CUSTOMER_ID is not null then coalesce(fw.v, 'Unknown') end as FAVORITE_WEEKDAY,
  case when o.CUSTOMER_ID is not null then coalesce(fh.v, -1) end as FAVORITE_HOUR
from rfm r
left join beh b on r.CUSTOMER_ID = b.CUSTOMER_ID
left join f_store fs on r.CUSTOMER_ID = fs.CUSTOMER_ID
left join f_type ft on r.CUSTOMER_ID = ft.CUSTOMER_ID
left join f_pay fp on r.CUSTOMER_ID = fp.CUSTOMER_ID
left join cat c on r.CUSTOMER_ID = c.CUSTOMER_ID
left join f_cat fc on r.CUSTOMER_ID = fc.CUSTOMER_ID
left join f_sub fsc on r.CUSTOMER_ID = fsc.CUSTOMER_ID
left join opsf o on r.CUSTOMER_ID = o.CUSTOMER_ID
left join f_wd fw on r.CUSTOMER_ID = fw.CUSTOMER_ID
left join f_hr fh on r.CUSTOMER_ID = fh.CUSTOMER_ID"""
    return ctes
