"""Sources and grids (S), universe (P, A, J), as-of fills and links (J, F), sorts and sets (O, U), checks (Q)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, checks, universe
from ..sources import readers, writers
from .base import PANEL_W, both, panel_w, q6, query, r6, scratch, table, weekly_facts, weeks

# Line items as raw daily security rows.
_SEC = """
SELECT l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS cap, l_extendedprice / l_quantity AS close,
       CASE WHEN s_acctbal >= 2000 THEN 'NS' ELSE 'AD' END AS share, 'EQTY' AS security, CASE WHEN s_suppkey % 7 = 0 THEN 'REIT' ELSE 'CORP' END AS issuer,
       CASE WHEN s_nationkey % 5 = 4 THEN 'X' ELSE 'N' END AS exchange, CASE WHEN s_suppkey % 11 = 3 THEN NULL ELSE 'Y' END AS us
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""
_SEC_DB = _SEC.format(lineitem="lineitem", supplier="supplier")
_ELIG = "coalesce(share = 'NS' AND security = 'EQTY' AND issuer IN ('CORP', 'REIT') AND exchange IN ('N', 'A', 'Q') AND us = 'Y', false)"


def sec_raw(spark, sf_dir) -> DataFrame:
    return both(spark, sf_dir, _SEC, "lineitem", "supplier")


def with_eligible(spark, sf_dir) -> DataFrame:
    return sec_raw(spark, sf_dir).withColumn("eligible", universe.eligible(*map(F.col, ("share", "security", "issuer", "exchange", "us"))))


@query("s01_read_daily", f"SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS id, {q6('CASE WHEN l_linenumber <> 7 THEN l_extendedprice END')} AS price, l_returnflag AS flag FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1998-01-01'")
def read_daily(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(
        F.date_format("l_shipdate", "yyyyMMdd").alias("day"),
        F.col("l_suppkey").cast("string").alias("id"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("price"),
        F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("flag"),
    )
    return readers.read_daily(raw, "day", ["price"], ["flag"], ["id"], "1996-01-01", "1997-12-31").withColumn("price", r6("price"))


@query("s02_parse_yyyymmdd", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def parse_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("19xx1301")
    return table(spark, sf_dir, "orders").select("o_orderkey", readers.parse_yyyymmdd(text).alias("day"))


@query("s03_read_wide_panels", f"{PANEL_W} SELECT date, symbol, {q6('close')} AS close, {q6('volume')} AS volume FROM panel WHERE close IS NOT NULL OR volume IS NOT NULL")
def read_wide(spark, sf_dir):
    values = {"close": "close", "volume": "volume", "_hidden": "low", "sector": "low"}
    out = readers.read_wide_panels(spark, writers.write_wide_panels(weekly_facts(spark, sf_dir), scratch(spark, "wide"), values))
    return out.withColumns({c: r6(c) for c in ("close", "volume")})


@query("s04_write_panels", f"{PANEL_W} SELECT year(date)::INT AS year, count(*) AS n, count(close) AS n_close FROM panel GROUP BY 1")
def write_panels(spark, sf_dir):
    path = scratch(spark, "panel")
    writers.write_panel(panel_w(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("n_close"))


@query("s05_read_jdbc_yearly", "SELECT CASE WHEN o_orderkey % 13 <> 4 THEN year(o_orderdate) END AS year, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, max(o_orderdate::DATE) FILTER (o_orderkey % 13 <> 4) AS last_day FROM orders GROUP BY 1")
def jdbc_yearly(spark, sf_dir):
    """Orders, some without a date, in a database in the driver's memory (Spark brings one along), read back by year. Other masters than a local one need a server."""
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    day = F.when(F.col("o_orderkey") % 13 != 4, F.col("o_orderdate").cast("date"))
    table(spark, sf_dir, "orders").select("o_orderkey", day.alias("o_orderdate")).write.jdbc(url, "orders", properties=driver)
    back = readers.read_jdbc_yearly(spark, url, "orders", '"o_orderdate"', 1990, 2010, driver)
    return back.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.max("o_orderdate").alias("last_day"))


@query("s06_fundamentals_extract", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def extract(spark, sf_dir):
    header = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").withColumnRenamed("c_custkey", "o_custkey")
    out = readers.fundamentals_extract(table(spark, sf_dir, "orders"), header, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, "o_custkey", ("c_mktsegment",))
    return out.select("o_orderkey", "o_custkey", "c_mktsegment")


@query("s07_enforce_contract", "SELECT s_suppkey AS symbol, s_acctbal AS balance, NULL::DOUBLE AS spread FROM supplier")
def contract(spark, sf_dir):
    out = readers.enforce_contract(table(spark, sf_dir, "supplier"), ["symbol", "balance"], ["spread"], {"s_suppkey": "symbol", "s_acctbal": "balance"}, ["symbol"])
    return out.select("symbol", "balance", "spread")


@query("s08_drop_duplicates_keep_last", f"SELECT symbol, date, {q6('close')} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS k FROM ({_SEC_DB})) WHERE k = 1")
def keep_last(spark, sf_dir):
    return readers.drop_duplicates_keep_last(sec_raw(spark, sf_dir), ["symbol", "date"], "seq").select("symbol", "date", r6("close").alias("close"))


@query("s09_abs_price", f"SELECT c_custkey, {q6('abs(c_acctbal)')} AS price FROM customer")
def abs_price(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", r6(readers.abs_price(F.col("c_acctbal"))).alias("price"))


@query("s10_densify", f"{PANEL_W} SELECT date, t, symbol, {q6('close')} AS close FROM panel")
def densify(spark, sf_dir):
    return readers.densify(weekly_facts(spark, sf_dir), days=weeks(spark, sf_dir)).select("date", "t", "symbol", r6("close").alias("close"))


@query("s11_rename_fields", "SELECT p_partkey AS part, p_retailprice AS price, p_size FROM part")
def rename(spark, sf_dir):
    out = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").alias("P_SIZE"))
    return readers.rename_fields(out, {"p_partkey": "part", "p_retailprice": "price"}, ("P_SIZE",))


@query("p01_eligible", f"SELECT symbol, count(*) AS n, sum({_ELIG}::INT)::BIGINT AS n_eligible FROM ({_SEC_DB}) GROUP BY symbol")
def eligible(spark, sf_dir):
    return with_eligible(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("eligible").cast("bigint")).alias("n_eligible"))


@query("p03_price_floor", f"{PANEL_W} SELECT date, symbol, coalesce(member AND close >= 1500, false) AS member FROM panel")
def floor(spark, sf_dir):
    return panel_w(spark, sf_dir).select("date", "symbol", universe.price_floor(F.col("member"), F.col("close"), 1500.0).alias("member"))


_YEARS = f"y AS (SELECT symbol, year(date)::INT AS year, sum(cap) AS cap_sum, count(cap) AS cap_count, bool_or({_ELIG}) AS any_eligible FROM ({_SEC_DB}) GROUP BY 1, 2)"
_SHOWN = f"symbol, year, {q6('cap_sum')} AS cap_sum, cap_count, any_eligible"


@query("a01_year_aggregates", f"WITH {_YEARS} SELECT {_SHOWN} FROM y")
def year_aggregates(spark, sf_dir):
    return universe.year_aggregates(with_eligible(spark, sf_dir)).withColumn("cap_sum", r6("cap_sum"))


@query("a02_merge_aggregates", f"WITH {_YEARS} SELECT {_SHOWN} FROM y")
def merge_aggregates(spark, sf_dir):
    rows = with_eligible(spark, sf_dir)
    parts = [universe.year_aggregates(rows.where(F.col("seq") % 3 == i)) for i in range(3)]
    return universe.merge_aggregates(*parts).withColumn("cap_sum", r6("cap_sum"))


_UNIVERSE = f"""{_YEARS}, src AS (SELECT year, CASE WHEN year - 1 IN (SELECT year FROM y) THEN year - 1 ELSE year END AS s FROM (SELECT DISTINCT year FROM y)),
    u AS (SELECT * FROM (SELECT src.year, symbol, row_number() OVER (PARTITION BY src.year ORDER BY round(cap_sum / cap_count + 3.71828e-8, 6) DESC, symbol) AS place FROM src JOIN y ON y.year = s WHERE any_eligible AND cap_count > 0) WHERE place <= 20)"""


def chosen(spark, sf_dir) -> DataFrame:
    by_year = universe.year_aggregates(with_eligible(spark, sf_dir)).withColumn("cap_sum", F.round(F.col("cap_sum") / F.col("cap_count") + 3.71828e-8, 6) * F.col("cap_count"))
    return universe.select_universe(by_year, 20)


@query("a03_select_universe", f"WITH {_UNIVERSE} SELECT year, symbol, place::INT AS place FROM u")
def select_universe(spark, sf_dir):
    return chosen(spark, sf_dir)


@query("o01_top_n_per_group", f"WITH {_UNIVERSE} SELECT year, symbol FROM u WHERE place <= 3")
def top_per_group(spark, sf_dir):
    return chosen(spark, sf_dir).where("place <= 3").select("year", "symbol")


@query("a04_year_mask", f"{PANEL_W}, {_UNIVERSE} SELECT date, p.symbol, u.symbol IS NOT NULL AS selected FROM panel p LEFT JOIN u ON u.year = year(date) AND u.symbol = p.symbol")
def year_mask(spark, sf_dir):
    return universe.year_mask(panel_w(spark, sf_dir), chosen(spark, sf_dir)).select("date", "symbol", "selected")


@query("a05_finalize_membership", f"{PANEL_W}, {_UNIVERSE} SELECT date, p.symbol, u.symbol IS NOT NULL AND close IS NOT NULL AS member FROM panel p LEFT JOIN u ON u.year = year(date) AND u.symbol = p.symbol")
def membership(spark, sf_dir):
    return universe.finalize_membership(universe.year_mask(panel_w(spark, sf_dir), chosen(spark, sf_dir))).select("date", "symbol", "member")


@query("j02_outer_alignment", f"{PANEL_W}, m AS (SELECT date, symbol, member FROM panel WHERE t % 2 = 0), f AS (SELECT date, symbol, close FROM panel WHERE t % 3 = 0) SELECT date, symbol, coalesce(member, false) AS member, {q6('close')} AS close FROM m FULL JOIN f USING (date, symbol)")
def outer(spark, sf_dir):
    p = panel_w(spark, sf_dir)
    out = universe.align_outer(p.where("t % 2 = 0").select("date", "symbol", "member"), p.where("t % 3 = 0").select("date", "symbol", "close"))
    return out.select("date", "symbol", "member", r6("close").alias("close"))


@query("j03_reindex", f"{PANEL_W} SELECT date, symbol, {q6('CASE WHEN symbol % 2 = 0 THEN close END')} AS close FROM panel WHERE t % 4 = 0")
def reindex(spark, sf_dir):
    p = panel_w(spark, sf_dir)
    return p.where("t % 4 = 0").select("date", "symbol").join(p.where("symbol % 2 = 0").select("date", "symbol", r6("close").alias("close")), ["date", "symbol"], "left")


# Orders as sparse observations of customers, some on weekends; the grid has a row per customer and Monday.
_OBS = "SELECT o_orderkey AS seq, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM {orders}"
_GRID = "SELECT d.date, c.symbol, (c.symbol + month(d.date)) % 7 <> 0 AS member FROM (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM {orders}) d CROSS JOIN (SELECT DISTINCT o_custkey AS symbol FROM {orders}) c"
_LAST = f"SELECT symbol, date, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS k FROM ({_OBS.format(orders='orders')})) WHERE k = 1"


@query("j04_asof_fill", f"SELECT g.date, g.symbol, {q6('CASE WHEN member THEN value END')} AS value FROM ({_GRID.format(orders='orders')}) g ASOF LEFT JOIN ({_LAST}) o ON g.symbol = o.symbol AND g.date >= o.date")
def asof_fill(spark, sf_dir):
    obs, grid = both(spark, sf_dir, _OBS, "orders"), both(spark, sf_dir, _GRID, "orders")
    out = asof.to_daily(obs, grid, ["value"], "seq")
    return out.select("date", "symbol", r6("value").alias("value"))


# Parts by quarter as fundamentals; the span of a part and a supplier is when they shipped together.
_FUND = """
SELECT gvkey, datadate, CASE WHEN gvkey % 7 <> 0 THEN rdq END AS rdq, atq, ltq, atq - ltq AS ceqq, saleq, saleq + taxq AS revtq, cogsq, 0.8 * ibq AS niq, ibq, ibq + taxq AS oiadpq,
       0.5 * ltq AS dlttq, 0.6 * atq AS actq, 0.4 * atq + ltq AS lctq, 10 * taxq AS cheq, qty AS cshoq, -price AS prccq, CASE WHEN gvkey % 5 = 0 THEN 0.0 ELSE taxq END AS xrdq
FROM (SELECT l_partkey AS gvkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS datadate, CAST(max(o_orderdate) AS DATE) AS rdq,
             round(sum(l_extendedprice), 4) AS atq, round(sum(l_extendedprice * l_discount), 4) AS ltq, round(sum(l_extendedprice * (1 - l_discount)), 4) AS saleq,
             round(sum(l_extendedprice * (0.5 - 10 * l_discount)), 4) AS ibq, round(sum(l_extendedprice * l_tax), 4) AS taxq, round(sum(l_extendedprice) * 0.7, 4) AS cogsq,
             sum(l_quantity) AS qty, round(avg(l_extendedprice / l_quantity) + 3.71828e-8, 6) AS price
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2) AS q
"""
_FUND_DB = _FUND.format(lineitem="lineitem", orders="orders")
_SPANS = 'SELECT l_partkey AS gvkey, l_suppkey AS permno, CAST(min(l_shipdate) AS DATE) AS "start", CAST(max(l_shipdate) AS DATE) AS "end" FROM lineitem GROUP BY 1, 2'
_LINKED = f"""SELECT f.*, permno, s."start", s."end" FROM (SELECT *, CAST(coalesce(rdq, datadate + 90) AS DATE) AS eff_date FROM ({_FUND_DB})) f JOIN ({_SPANS}) s USING (gvkey)
    WHERE eff_date >= s."start" - 400 AND eff_date <= s."end" + 400"""
_MATCH = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gvkey, datadate ORDER BY (eff_date >= "start" AND eff_date <= "end") DESC, (permno % 3 = 0) DESC, abs(2 * (eff_date - "start") - ("end" - "start")), permno) AS k FROM ({_LINKED})) WHERE k = 1"""


def fund(spark, sf_dir) -> DataFrame:
    rows = both(spark, sf_dir, _FUND, "lineitem", "orders")
    return rows.withColumn("eff_date", asof.effective_date(F.col("rdq"), F.col("datadate"))).where(F.col("eff_date").isNotNull())


def spans(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gvkey"), F.col("l_suppkey").alias("permno"), F.col("l_shipdate").cast("date").alias("day"))
    return asof.build_spans(li, "gvkey", "permno", "day")


def matched(spark, sf_dir, *columns: str) -> DataFrame:
    """The best match of every report, with the columns named (all of the report's by default): what is asked for is all that a row carries."""
    rows = fund(spark, sf_dir)
    linked = asof.link_by_span(rows.select(*columns) if columns else rows, spans(spark, sf_dir), "gvkey")
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("permno"))
    return asof.best_match(linked, ["gvkey", "datadate"], known, "permno")


@query("j05_link_by_span", f'SELECT gvkey, datadate, permno, eff_date FROM ({_LINKED})')
def link(spark, sf_dir):
    return asof.link_by_span(fund(spark, sf_dir), spans(spark, sf_dir), "gvkey").select("gvkey", "datadate", "permno", "eff_date")


@query("j06_best_match", f"SELECT gvkey, datadate, permno FROM ({_MATCH})")
def match(spark, sf_dir):
    return matched(spark, sf_dir, "gvkey", "datadate", "eff_date").select("gvkey", "datadate", "permno")


@query("j07_build_spans", f'SELECT gvkey, permno, "start" AS lo, "end" AS hi FROM ({_SPANS})')
def build_spans(spark, sf_dir):
    return spans(spark, sf_dir).select("gvkey", "permno", F.col("start").alias("lo"), F.col("end").alias("hi"))


@query("j08_semi_join", f"SELECT symbol, date, {q6('close')} AS close FROM ({_SEC_DB}) WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 2000)")
def semi(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").where("s_acctbal >= 2000").select(F.col("s_suppkey").alias("symbol"))
    return sec_raw(spark, sf_dir).select("symbol", "date", r6("close").alias("close")).join(ids, "symbol", "left_semi")


@query("j09_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark, sf_dir):
    return writers.new_rows(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("f01_effective_date", f"SELECT gvkey, datadate, CAST(coalesce(rdq, datadate + 90) AS DATE) AS eff_date FROM ({_FUND_DB})")
def effective(spark, sf_dir):
    return fund(spark, sf_dir).select("gvkey", "datadate", "eff_date")


_LEVELS = {
    "cs_gp_at": "(revtq - cogsq) / nullif(atq, 0)",
    "cs_roa": "niq / nullif(atq, 0)",
    "cs_roe": "niq / nullif(ceqq, 0)",
    "cs_opmargin": "oiadpq / nullif(saleq, 0)",
    "cs_gpmargin": "(revtq - cogsq) / nullif(revtq, 0)",
    "cs_leverage": "ltq / nullif(atq, 0)",
    "cs_debt_at": "dlttq / nullif(atq, 0)",
    "cs_current_ratio": "actq / nullif(lctq, 0)",
    "cs_cash_at": "cheq / nullif(atq, 0)",
    "cs_bm": "ceqq / nullif(abs(prccq) * cshoq, 0)",
    "cs_ep": "ibq / nullif(abs(prccq) * cshoq, 0)",
    "cs_sp": "saleq / nullif(abs(prccq) * cshoq, 0)",
    "cs_rd_sale": "xrdq / nullif(saleq, 0)",
}
_LAG = "lag({}, {}) OVER (PARTITION BY gvkey ORDER BY datadate)"
_GROWTH = {
    "f03_growth": {"cs_asset_growth": f"atq / nullif({_LAG.format('atq', 4)}, 0) - 1", "cs_sales_growth": f"saleq / nullif({_LAG.format('saleq', 4)}, 0) - 1"},
    "f04_earnings_growth": {"cs_earnings_growth": f"(ibq - {_LAG.format('ibq', 4)}) / nullif(abs({_LAG.format('ibq', 4)}), 0)"},
    "f05_accruals": {"cs_accruals": f"(((actq - cheq) - lctq) - {_LAG.format('((actq - cheq) - lctq)', 1)}) / nullif(atq, 0)"},
}


def _characteristics(name: str, columns: dict[str, str]) -> None:
    @query(name, f"SELECT gvkey AS symbol, datadate, {', '.join(f'{q6(s)} AS {c}' for c, s in columns.items())} FROM ({_FUND_DB})")
    def run(spark, sf_dir):
        out = asof.characteristics(fund(spark, sf_dir).withColumnRenamed("gvkey", "symbol"))
        return out.select("symbol", "datadate", *[r6(c).alias(c) for c in columns])


_characteristics("f02_level_ratios", _LEVELS)
for _name, _columns in _GROWTH.items():
    _characteristics(_name, _columns)


@query("v11_lag_quarters", f"SELECT gvkey AS symbol, datadate, {q6(_LAG.format('atq', 1))} AS lag1, {q6(_LAG.format('atq', 4))} AS lag4 FROM ({_FUND_DB})")
def lag_quarters(spark, sf_dir):
    rows = fund(spark, sf_dir).withColumnRenamed("gvkey", "symbol")
    return rows.select("symbol", "datadate", *[r6(asof.lag_quarters(F.col("atq"), k)).alias(f"lag{k}") for k in (1, 4)])


_QGRID = "SELECT d.date, p.symbol, true AS member FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM {orders}) d CROSS JOIN (SELECT p_partkey AS symbol FROM {part}) p"
_DAILY = {"f06_to_daily": ("cs_leverage",), "f07_sector_panel": ("sector",), "f08_ratio_panels": ("cs_roa", "cs_sp", "cs_debt_at")}


def _daily(name: str, values: tuple[str, ...]) -> None:
    forms = _LEVELS | {"sector": "(gvkey % 5)::DOUBLE"}
    obs = f"SELECT gvkey AS symbol, datadate, CAST(coalesce(rdq, datadate + 90) AS DATE) AS date, {', '.join(f'{forms[v]} AS {v}' for v in values)} FROM ({_FUND_DB})"
    last = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY datadate DESC) AS k FROM ({obs})) WHERE k = 1"

    @query(name, f"SELECT g.date, g.symbol, {', '.join(f'{q6(v)} AS {v}' for v in values)} FROM ({_QGRID.format(orders='orders', part='part')}) g ASOF LEFT JOIN ({last}) o ON g.symbol = o.symbol AND g.date >= o.date")
    def run(spark, sf_dir):
        rows = fund(spark, sf_dir).withColumnRenamed("gvkey", "symbol")
        obs = asof.characteristics(rows) if values != ("sector",) else rows.select("symbol", F.col("eff_date").alias("date"), "datadate", (F.col("symbol") % 5).cast("double").alias("sector"))
        out = asof.to_daily(obs, both(spark, sf_dir, _QGRID, "orders", "part"), list(values), "datadate")
        return out.select("date", "symbol", *[r6(v).alias(v) for v in values])


for _name, _values in _DAILY.items():
    _daily(_name, _values)


@query("f09_month_end_plus_one", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS active FROM orders")
def month_end(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", asof.month_end_plus_one(text).alias("active"))


_MONTHLY = "SELECT o_custkey AS permno, date_format(o_orderdate, 'yyyyMM') AS yyyymm, max(o_orderkey) AS seq, round(sum(o_totalprice), 4) AS osap_size, CASE WHEN o_custkey % 50 = 0 THEN 1.0 END AS osap_rare FROM {orders} GROUP BY 1, 2, o_custkey"
_MDB = "SELECT o_custkey AS symbol, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS date, round(sum(o_totalprice), 4) AS osap_size FROM orders GROUP BY 1, 2"


@query("f10_ingest_monthly", f"SELECT g.date, g.symbol, {q6('CASE WHEN member THEN osap_size END')} AS osap_size FROM ({_GRID.format(orders='orders')}) g ASOF LEFT JOIN ({_MDB}) o ON g.symbol = o.symbol AND g.date >= o.date")
def ingest_monthly(spark, sf_dir):
    out, _ = asof.ingest_monthly(both(spark, sf_dir, _MONTHLY, "orders"), both(spark, sf_dir, _GRID, "orders"), ["osap_size", "osap_rare"], "seq", 0.2, 5)
    return out.select("date", "symbol", r6("osap_size").alias("osap_size"))


@query("u01_concat", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def concat(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parts = [o.where(F.col("o_orderkey") % 3 == i).select("o_orderkey", F.col("o_orderstatus").alias("status")) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("u02_index_union_intersection", "SELECT day, true AS in_both FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem) UNION ALL SELECT day, false FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def index_sets(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return a.intersect(b).withColumn("in_both", F.lit(True)).unionByName(a.union(b).distinct().withColumn("in_both", F.lit(False)))


@query("u03_ordered_distinct", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS first_seq FROM lineitem GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return readers.drop_duplicates_keep_last(li.withColumn("seq", -F.col("seq")), ["l_partkey"], "seq").select("l_partkey", (-F.col("seq")).alias("first_seq"))


@query("o05_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def keep_first(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(order)).where("k = 1").select("o_custkey", "o_orderkey")


_CHECKS = f"""{PANEL_W}, a AS (SELECT *, coalesce(lead(member) OVER (PARTITION BY symbol ORDER BY t), false) AS nm, lead(returns) OVER (PARTITION BY symbol ORDER BY t) AS nr FROM panel),
    s AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM panel WHERE close IS NOT NULL GROUP BY 1), e AS (SELECT min(date) AS a, max(date) AS b FROM panel),
    v AS (SELECT count(*) AS n, count(DISTINCT date) AS nd, count(DISTINCT symbol) AS ns, max(CASE WHEN member AND nm THEN abs(forward_returns - nr) END) AS sh, max(CASE WHEN member THEN abs(forward_returns - returns) END) AS sd,
          (SELECT count(*) FROM s, e WHERE hi < b - 60) AS ex, (SELECT count(*) FROM s, e WHERE lo > a + 60) AS en, (SELECT quantile_cont(k, 0.5) FROM (SELECT count(close) AS k FROM panel GROUP BY date)) AS mb FROM a)"""


@query(
    "q01_panel_checks",
    f"""{_CHECKS} SELECT unnest(['shared_grid', 'ids_in_universe', 'double_fields', 'sector_is_no_field', 'forward_is_next_return', 'forward_is_not_same_day', 'exits', 'entries', 'names', 'fundamentals_after_prices', 'median_breadth']) AS "check",
        unnest([n = nd * ns, true, true, true, coalesce(sh, 0) < 1e-9, sd > 1e-9, ex > 0, en > 0, ns > 50, true, mb >= 50]) AS ok FROM v""",
)
def panel_checks(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return checks.panel_checks(panel_w(spark, sf_dir), known, 50, 0, 50).select("check", "ok")


@query("v13_next_day_check", f"{_CHECKS} SELECT coalesce(sh, 0.0) < 1e-9 AS ok FROM v")
def next_day(spark, sf_dir):
    return checks.forward_alignment(panel_w(spark, sf_dir))
