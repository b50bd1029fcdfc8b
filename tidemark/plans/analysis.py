"""The analytical queries, block by block."""

from __future__ import annotations

from .blocks import DELIVERY, ITEM, ORDER, Block, count, pick, ratio, total

MONTH = {"ym": "ym"}
_LAST = "OVER (ORDER BY ym)"


def lagged(*names: str) -> dict[str, str]:
    return {f"prev_{n}": f"lag({n}) {_LAST}" for n in names}


def deltas(*names: str) -> dict[str, str]:
    out = {f"{n}_delta": f"{n} - prev_{n}" for n in names}
    return out | {f"{n}_change": ratio(f"({n} - prev_{n})", f"prev_{n}") for n in names}


def share(name: str, over: str = "") -> str:
    """Share of the total; the total is summed as a decimal, so that its order doesn't matter."""
    return ratio(name, f"sum(CAST({name} AS DECIMAL(28,4))) OVER ({over})")


# Band edges of the analyses.
DISCOUNT = "CASE WHEN discount = 0 THEN '0' WHEN CAST(discount AS DOUBLE) / CAST(gross AS DOUBLE) <= 0.05 THEN '0-5%' WHEN CAST(discount AS DOUBLE) / CAST(gross AS DOUBLE) <= 0.10 THEN '5-10%' WHEN CAST(discount AS DOUBLE) / CAST(gross AS DOUBLE) <= 0.20 THEN '10-20%' ELSE '>20%' END"
DISCOUNT_ORDER = "CASE WHEN discount = 0 THEN 1 WHEN CAST(discount AS DOUBLE) / CAST(gross AS DOUBLE) <= 0.05 THEN 2 WHEN CAST(discount AS DOUBLE) / CAST(gross AS DOUBLE) <= 0.10 THEN 3 WHEN CAST(discount AS DOUBLE) / CAST(gross AS DOUBLE) <= 0.20 THEN 4 ELSE 5 END"
MARGIN = "CASE WHEN margin < 0 THEN 'Negativa' WHEN margin = 0 THEN 'Zero' WHEN CAST(margin AS DOUBLE) / CAST(net AS DOUBLE) < 0.1 THEN '<10%' ELSE '>=10%' END"
BASKET = "CASE WHEN line_count = 1 THEN '1' WHEN line_count = 2 THEN '2' WHEN line_count <= 4 THEN '3-4' ELSE '5+' END"
VALUE = "CASE WHEN net <= 50000 THEN '1: <=50k' WHEN net <= 100000 THEN '2: 50-100k' WHEN net <= 200000 THEN '3: 100-200k' ELSE '4: >200k' END"
FREQUENCY = "CASE WHEN orders = 1 THEN '1' WHEN orders <= 3 THEN '2-3' WHEN orders <= 6 THEN '4-6' ELSE '7+' END"
SEVERITY = "CASE WHEN late_days = 0 THEN '0: none' WHEN late_days <= 1 THEN '1: 1 day' WHEN late_days <= 3 THEN '2: 2-3 days' WHEN late_days <= 7 THEN '3: 4-7 days' ELSE '4: >7 days' END"
GROWTH = """CASE WHEN net > prev_net AND margin_pct < prev_margin_pct THEN 'RECEITA_CRESCE_MARGEM_PERCENTUAL_CAI'
  WHEN net > prev_net AND margin > prev_margin THEN 'CRESCIMENTO_COM_MARGEM_MONETARIA' WHEN net < prev_net THEN 'RECEITA_EM_QUEDA' ELSE 'ESTAVEL_OU_MISTO' END"""
SMALL = "CASE WHEN {n} < {k} THEN 'AMOSTRA_PEQUENA' ELSE 'OK' END"
PER_CLIENT = {"orders": count(), "net": total("net"), "margin": total("margin"), "units": total("units"), "discount": total("discount"), "gross": total("gross"), "cost": total("cost")}
OF_CLIENTS = {"clients": count(), "orders": "CAST(sum(orders) AS BIGINT)", "mean_orders": ratio("sum(orders)", "count(*)")}


def small(n: str, k: int) -> dict[str, str]:
    return {"sample": SMALL.format(n=n, k=k)}


def by(grain: str, measures: dict, *dims: str, **more) -> Block:
    return Block(grain, {d: d for d in dims}, measures, **more)


LATE_BY = pick(DELIVERY, "deliveries", "late", "late_rate", "service_level", "mean_late_days", "mean_rating")
MIX = pick(ORDER, "orders", "clients", "units", "net", "ticket", "items_per_order", "discount_pct", "margin_pct")
SHARES = [{"orders_share": share("orders"), "net_share": share("net")}]

BLOCKS: dict[str, Block] = {
    # scope and headline figures
    "e00b_macro": Block("ord", {}, ORDER | {"mean_products": ratio("sum(products)", "count(*)")}),
    # client behaviour
    "e03a_client_base": Block("ord", {"client_id": "client_id"}, PER_CLIENT | {"first_date": "min(order_date)", "last_date": "max(order_date)", "ticket": ratio("sum(net)", "count(*)")}),
    "e03g_category": by("item", ITEM, "category"),
    "e04e_channel_campaign_event": by("ord", MIX, "channel", "campaign", "external_event", post=[small("orders", 30)]),
    "e04f_category_payment_campaign": by("item", ITEM, "category", "payment", "campaign", joins=[("ord", "order_id")]),
    "e04g_region_carrier_status": by("delivery", LATE_BY, "region", "carrier", "status"),
    # commercial
    "e07a_commercial_kpis": Block("ord", {}, MIX),
    "e07b_monthly": Block("ord", MONTH, pick(ORDER, "orders", "clients", "units", "net", "ticket"), post=[lagged("net", "orders"), deltas("net", "orders")]),
    "e07d_frequency_bands": Block("ord", {"client_id": "client_id"}, PER_CLIENT, then=({"band": FREQUENCY}, OF_CLIENTS), post=[{"client_share": share("clients")}]),
    "e07g_top_products": by("item", ITEM, "product_id", "product", top=("net DESC, product_id", 20)),
    "e07h_basket_bands": Block("ord", {"basket": BASKET}, MIX, post=SHARES),
    "e07i_weekday_band": Block("ord", {"weekday": "CAST(weekday(order_date) + 1 AS INT)", "time_band": "time_band"}, MIX),
    # finance
    "e08a_financial_summary": Block("ord", {}, ORDER),
    "e08b_financial_monthly": Block("ord", MONTH, ORDER, post=[lagged("net", "margin", "cost"), deltas("net", "margin", "cost")]),
    "e08c_payment": by("ord", ORDER, "payment", post=SHARES),
    "e08d_discount_bands": Block("ord", {"band": DISCOUNT, "band_order": DISCOUNT_ORDER}, ORDER, post=SHARES),
    "e08e_category_profit": by("item", ITEM, "category", post=[{"margin_share": share("margin")}]),
    "e08f_product_profit": by("item", ITEM, "product_id", "product", "category"),
    "e08g_margin_bands": Block("ord", {"band": MARGIN}, ORDER, post=SHARES),
    "e08h_lowest_margin": by("ord", pick(ORDER, "gross", "discount", "net", "cost", "margin", "margin_pct"), "order_id", "client_id", top=("margin, order_id", 30)),
    "e08i_client_profit": by("ord", ORDER, "client_id", "client_name", "region", joins=[("client", "client_id")]),
    "e08k_freight_by_value": Block("delivery", {"band": VALUE}, {"orders": count(), "free": count("CASE WHEN free_shipping = 'Sim' THEN 1 END"), "free_rate": ratio("count(CASE WHEN free_shipping = 'Sim' THEN 1 END)", "count(*)"), "freight": total("freight"), "mean_paid_freight": ratio("sum(CASE WHEN freight > 0 THEN freight END)", "count(CASE WHEN freight > 0 THEN 1 END)"), "net": total("net")}),
    # marketing
    "e09a_with_without_campaign": by("ord", ORDER, "has_campaign", post=SHARES),
    "e09b_channel": by("ord", ORDER, "channel", post=SHARES + [small("orders", 30)]),
    "e09c_campaign": by("ord", ORDER, "campaign", post=SHARES + [small("orders", 30)]),
    "e09d_event": by("ord", ORDER, "external_event", post=SHARES + [small("orders", 30)]),
    "e09e_coupon": Block("ord", {"coupon": "coalesce(nullif(trim(coupon), ''), '[NULO]')"}, ORDER, post=SHARES),
    "e09f_channel_campaign": by("ord", ORDER, "channel", "campaign"),
    "e09g_campaign_event": by("ord", ORDER, "campaign", "external_event"),
    "e09h_month_channel": by("ord", MIX, "ym", "channel"),
    "e09i_category_campaign": by("item", ITEM, "category", "campaign", joins=[("ord", "order_id")]),
    "e09j_channel_reach": Block("ord", {"channel": "channel", "client_id": "client_id"}, PER_CLIENT, then=({"channel": "channel"}, OF_CLIENTS | {"recurring": count("CASE WHEN orders > 1 THEN 1 END"), "recurring_rate": ratio("count(CASE WHEN orders > 1 THEN 1 END)", "count(*)")})),
    "e09k_campaign_dependency": by("ord", {"orders": count(), "campaign_orders": "CAST(sum(has_campaign) AS BIGINT)", "campaign_order_share": ratio("sum(has_campaign)", "count(*)"), "campaign_net": total("CASE WHEN has_campaign = 1 THEN net END"), "campaign_net_share": ratio("sum(CASE WHEN has_campaign = 1 THEN net END)", "sum(net)")}, "channel"),
    "e09l_campaign_effect": by("ord", {"orders_with": count("CASE WHEN has_campaign = 1 THEN 1 END"), "orders_without": count("CASE WHEN has_campaign = 0 THEN 1 END"), "ticket_with": ratio("sum(CASE WHEN has_campaign = 1 THEN net END)", "count(CASE WHEN has_campaign = 1 THEN 1 END)"), "ticket_without": ratio("sum(CASE WHEN has_campaign = 0 THEN net END)", "count(CASE WHEN has_campaign = 0 THEN 1 END)")}, "channel", post=[{"difference": ratio("(ticket_with - ticket_without)", "ticket_without")}, {"sample": "CASE WHEN orders_with < 30 OR orders_without < 30 THEN 'AMOSTRA_PEQUENA' ELSE 'OK' END"}]),
    # logistics
    "e10a_operations": Block("delivery", {}, DELIVERY),
    "e10b_status": by("delivery", DELIVERY, "status", post=[{"status_share": share("deliveries")}]),
    "e10c_carrier": by("delivery", DELIVERY, "carrier", post=[small("deliveries", 30)]),
    "e10d_region": by("delivery", DELIVERY, "region"),
    "e10e_city": by("delivery", DELIVERY, "region", "city", post=[small("deliveries", 30)]),
    "e10f_carrier_region": by("delivery", DELIVERY, "carrier", "region", post=[small("deliveries", 30)]),
    "e10g_monthly_service": by("delivery", DELIVERY, "ym"),
    "e10h_severity": Block("delivery", {"severity": SEVERITY}, DELIVERY, post=[{"severity_share": share("deliveries")}]),
    "e10i_delay_rating": Block("delivery", {"late_days": "late_days"}, {"deliveries": count(), "rated": count("rating"), "mean_rating": ratio("sum(rating)", "count(rating)")}),
    "e10j_free_shipping": by("delivery", DELIVERY | {"freight": total("freight"), "ticket": ratio("sum(net)", "count(*)")}, "free_shipping"),
    "e10k_value_band": Block("delivery", {"band": VALUE}, DELIVERY),
    "e10l_longest_delays": by("delivery", {"late_days": "max(late_days)", "promised": "max(promised)", "actual": "max(actual)", "net": total("net")}, "order_id", "client_id", "carrier", top=("late_days DESC, order_id", 30)),
    "e12a_delay_flag": Block("delivery", {"late_flag": "late_flag"}, {"deliveries": count()}),
    # growth
    "ac1_monthly_evolution": Block("ord", MONTH, ORDER, post=[lagged("net", "orders", "clients", "margin", "ticket"), deltas("net", "orders", "clients", "margin", "ticket")]),
    "ac3_ticket_decomposition": Block("ord", MONTH, pick(ORDER, "orders", "units", "net", "ticket") | {"ipo": ratio("sum(units)", "count(*)"), "rpi": ratio("sum(net)", "sum(units)")}, post=[lagged("ticket", "ipo", "rpi"), {"ticket_delta": "ticket - prev_ticket", "items_effect": "(ipo - prev_ipo) * (rpi + prev_rpi) / 2", "value_effect": "(rpi - prev_rpi) * (ipo + prev_ipo) / 2"}]),
    "ac6_category_month": Block("item", {"ym": "ym", "category": "category"}, ITEM, post=[{"net_share": share("net", "PARTITION BY ym"), "margin_share": share("margin", "PARTITION BY ym")}]),
    "ac7_product_month": Block("item", {"ym": "ym", "product_id": "product_id"}, pick(ITEM, "orders", "units", "net", "margin"), post=[{"prev_net": "lag(net) OVER (PARTITION BY product_id ORDER BY ym)", "prev_margin": "lag(margin) OVER (PARTITION BY product_id ORDER BY ym)"}, {"net_delta": "net - prev_net", "margin_delta": "margin - prev_margin"}]),
    "ac8_growth_alerts": Block(
        "ord", MONTH, pick(ORDER, "net", "margin", "margin_pct"), post=[lagged("net", "margin", "margin_pct"), {f"{n}_delta": f"{n} - prev_{n}" for n in ("net", "margin", "margin_pct")} | {"alert": GROWTH}],
        keep="prev_net IS NOT NULL",
    ),
    # catalogue
    "x1_commercial_metrics": Block("ord", {}, ORDER | {"distinct_products_per_order": ratio("sum(products)", "count(*)"), "frequency": ratio("count(*)", "count(DISTINCT client_id)"), "net_per_client": ratio("sum(net)", "count(DISTINCT client_id)"), "margin_per_client": ratio("sum(margin)", "count(DISTINCT client_id)")}),
    "x4_incentives": Block("delivery", {"has_campaign": "has_campaign", "free_shipping": "free_shipping"}, {"orders": count(), "net": total("net"), "ticket": ratio("sum(net)", "count(*)"), "margin_pct": ratio("sum(margin)", "sum(net)")}, joins=[("ord", "order_id")], post=SHARES),
    "x6_client_variables": by("ord", PER_CLIENT | {"first_date": "min(order_date)", "last_date": "max(order_date)", "campaign_share": ratio("sum(has_campaign)", "count(*)"), "discount_pct": ratio("sum(discount)", "sum(gross)"), "purchase_days": count("DISTINCT order_date"), "distinct_months": count("DISTINCT ym")}, "client_id"),
}
