"""Queries on numbers, dates, footnotes, markers, evidence and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions.dates import parse_dates
from gridsmith.functions.numbers import COMMA_GROUPING, FORMATS, POINT_GROUPING, interpretations, is_ambiguous, parse_numbers, scaled
from gridsmith.functions.text import is_missing, split_footnote
from gridsmith.operators.normalize import contexts, decimal_evidence, infer_types, normalize, with_readings
from gridsmith.plans.fixtures import cents, grouped, money, settings, spread, table, tokens

_CENTS = "cast(round({0} * 100) as bigint)"
_TEXT = "concat({0} // 100, '.', lpad(cast({0} % 100 as varchar), 2, '0'))"


def _lines(spark, sf_dir):
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents(F.col("l_extendedprice")).alias("c")))


def _orders(spark, sf_dir):
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("c")))


def _parsed(d: DataFrame, keys: list[str]) -> DataFrame:
    return d.select(*keys, F.col("n.canonical").alias("canonical"), F.col("n.fraction_digits").alias("fraction_digits"), F.col("n.used_grouping").alias("used_grouping"))


def parse_point_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).withColumn("raw", money(F.col("c")))
    return _parsed(parse_numbers(d, "raw", *FORMATS["pointDecimal"], "n"), ["l_orderkey", "l_linenumber"])


def parse_comma_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).withColumn("raw", money(F.col("c"), ".", ","))
    return _parsed(parse_numbers(d, "raw", *FORMATS["commaDecimal"], "n"), ["l_orderkey", "l_linenumber"])


_LINES_SQL = f"""
select l_orderkey, l_linenumber, {_TEXT.format('c')} canonical, 2 fraction_digits, c >= 100000 used_grouping
from (select l_orderkey, l_linenumber, {_CENTS.format('l_extendedprice')} c from lineitem)"""


def parse_space_nbsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(" ")
    d = _orders(spark, sf_dir).withColumn("raw", F.replace(money(F.col("c"), "_", ","), F.lit("_"), mark))
    return _parsed(parse_numbers(d, "raw", *FORMATS["spaceCommaDecimal"], "n"), ["o_orderkey"])


def parse_apostrophe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders(spark, sf_dir).withColumn("raw", F.concat(F.lit(" "), money(F.col("c"), "’"), F.lit(" ")))
    return _parsed(parse_numbers(d, "raw", *FORMATS["apostrophePointDecimal"], "n"), ["o_orderkey"])


_ORDERS_SQL = f"""
select o_orderkey, {_TEXT.format('c')} canonical, 2 fraction_digits, c >= 100000 used_grouping
from (select o_orderkey, {_CENTS.format('o_totalprice')} c from orders)"""


def parse_parentheses_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_custkey", cents(F.col("c_acctbal")).alias("c"))
    d = d.withColumn("raw", F.when(F.col("c") < 0, F.concat(F.lit("( "), money(-F.col("c")), F.lit(")"))).otherwise(money(F.col("c"))))
    d = parse_numbers(d, "raw", *FORMATS["pointDecimal"], "n")
    return d.select("c_custkey", F.col("n.canonical").cast("double").alias("amount"), F.col("n.parentheses").alias("parentheses"))


def parse_currency_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents(F.col("l_discount")).alias("p"), cents(F.col("l_extendedprice")).alias("c"))
    d = d.withColumn("a", F.concat(F.col("p").cast("string"), F.lit(" %")))
    amount = money(F.col("c"))
    d = d.withColumn("b", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("€ "), amount)).when(F.col("l_linenumber") % 3 == 1, F.concat(amount, F.lit(" CHF"))).otherwise(F.concat(F.lit("-$"), amount)))
    d = parse_numbers(parse_numbers(d, "a", ".", POINT_GROUPING, "x"), "b", ".", POINT_GROUPING, "y")
    return d.select("l_orderkey", "l_linenumber", F.col("x.canonical").alias("percent"), F.col("x.is_percent").alias("is_percent"), F.col("y.canonical").alias("amount"), F.col("y.currency").alias("currency"))


def parse_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    forms = [F.lit(""), F.concat(n, F.lit("kg")), F.concat(F.lit("1.2.3,"), n), F.concat(n, F.lit(",34,567.0")), F.lit("( )"), F.concat(F.lit("€"), n), F.concat(F.lit("1 234,567.")), F.concat(n, F.lit(".5"))]
    d = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_size") % 8 + 1)).alias("raw"), "p_size")
    d = parse_numbers(d, "raw", ".", POINT_GROUPING, "n")
    return d.select("p_partkey", F.col("n.error").alias("error"), F.col("n.canonical").alias("canonical"))


def ambiguous_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders(spark, sf_dir).withColumn("raw", grouped(F.floor(F.col("c") / 100)))
    d = interpretations(d, "raw")
    return d.select("o_orderkey", is_ambiguous().alias("ambiguous"), F.col("point.canonical").alias("with_point"), F.col("comma.canonical").alias("with_comma"))


def scale_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", cents(F.col("p_retailprice")).alias("c")).withColumn("raw", money(F.col("c")))
    d = parse_numbers(d, "raw", *FORMATS["pointDecimal"], "n")
    return d.select("p_partkey", scaled(F.col("n.canonical"), F.lit("1000")).cast("double").alias("units"), scaled(F.col("n.canonical"), F.lit("0.001")).alias("thousands"))


def footnote_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ["", "*", "†", "(a)", " (12)", "¹²", "*†"]
    mark = F.element_at(F.array(*map(F.lit, marks)), F.col("l_linenumber").cast("int"))
    d = _lines(spark, sf_dir).withColumn("raw", F.concat(money(F.col("c")), mark))
    value, marker = split_footnote(F.col("raw"))
    return d.select("l_orderkey", "l_linenumber", value.alias("value"), marker.alias("marker"))


def missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", cents(F.col("value")).alias("c"))
    k = F.col("event_id") % 7
    text = F.when(k == 0, " - ").when(k == 1, "n/a").when(k == 2, "").when(k == 3, "…").when(k == 4, "- *").otherwise(money(F.col("c")))
    d = e.withColumns({"text": text, "type": F.when(F.col("event_id") % 2 == 0, "decimal").otherwise("text"), "scale": F.lit("1"), "decimal": F.lit("."), "grouping": F.lit(POINT_GROUPING), "date_order": F.lit("auto"), "missing_tokens": tokens(), "strip": F.lit(True)})
    d = normalize(d)
    return d.select("event_id", F.col("norm.kind").alias("kind"), F.col("norm.missing_token").alias("token"))


def date_parse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    f = lambda p: F.date_format(day, p)
    forms = [f("yyyy-MM-dd"), f("dd.MM.yyyy"), f("MM/yyyy"), f("d MMMM yyyy"), f("yyyy"), F.concat(F.lit("31/02/"), f("yyyy"))]
    d = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("raw"))
    d = parse_dates(d, "raw", "dmy", "d")
    return d.select("o_orderkey", F.col("d.kind").alias("kind"), F.col("d.iso").alias("iso"))


def date_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "d/M/yyyy").alias("raw"))
    d = parse_dates(d, "raw", "auto", "d")
    return d.select("o_orderkey", F.col("d.kind").alias("kind"), F.col("d.iso").alias("iso"))


def date_order_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.lit(0).alias("col"), F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy").alias("text"))
    cols = o.select("table_id").distinct().select("table_id", F.lit(0).alias("col"), F.lit("date").alias("type"), F.lit("auto").alias("number_format"))
    c = contexts(with_readings(o), cols, settings(cols))
    return c.select("table_id", "date_order", "date_resolution")


def column_decimal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.lit(0).alias("col"), "l_linenumber", cents(F.col("l_extendedprice")).alias("c")))
    n = F.col("l_linenumber")
    text = F.when(n == 1, money(F.col("c"))).when(n == 7, grouped(F.floor(F.col("c") / 100))).otherwise(money(F.col("c"), ".", ","))
    return decimal_evidence(with_readings(li.withColumn("text", text)), ["table_id", "col"]).drop("col")


def table_context_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), cents(F.col("l_extendedprice")).alias("c"), "l_linenumber").repartition("table_id")  # a scan may have few parts
    price = F.when(F.col("table_id") % 3 == 0, money(F.col("c"))).when(F.col("table_id") % 3 == 1, money(F.col("c"), ".", ",")).otherwise(grouped(F.floor(F.col("c") / 100)))
    d = li.select("table_id", F.posexplode(F.array(price, grouped(F.floor(F.col("c") / 100)))).alias("col", "text"))
    cols = d.select("table_id", "col").distinct().withColumns({"type": F.lit("decimal"), "number_format": F.lit("auto")})
    c = contexts(with_readings(d), cols, settings(cols.select("table_id").distinct()))
    return c.select("table_id", "col", "decimal", "resolution")


def infer_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    def melt(name: str, /, **texts) -> DataFrame:
        t = table(spark, sf_dir, name)
        each = F.array(*[F.struct(F.lit(h).alias("header"), x.alias("text")) for h, x in texts.items()])
        return t.select(F.lit(name).alias("table_id"), F.posexplode(each).alias("col", "x")).select("table_id", "col", "x.*")

    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    parts = [
        melt("nation", key=F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), name=F.col("n_name")),
        melt("part", price=money(cents(F.col("p_retailprice"))), cost=F.concat(F.lit("$ "), money(cents(F.col("p_retailprice")))), size=F.col("p_size").cast("string"), sku=F.concat(F.lit("P-"), F.col("p_partkey").cast("string")), brand=F.col("p_brand")),
        melt("orders", day=day, total=grouped(F.floor(F.col("o_totalprice"))), year=F.left(day, F.lit(4)), postcode=F.col("o_custkey").cast("string"), share=F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%"))),
    ]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2])
    headers = d.select("table_id", "col", "header").distinct()
    return infer_types(with_readings(d.drop("header")), headers).join(headers, ["table_id", "col"]).select("table_id", "header", "type")


def locale_parse_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every order as a table of locale texts, read by its own evidence, checked against its total row."""
    from gridsmith.operators.rules import check_totals
    from gridsmith.plans.fixtures import normalized_orders

    totals = check_totals(normalized_orders(spark, sf_dir))
    money_ = lambda c: F.col(c).cast("double").alias(c)
    return totals.select("table_id", money_("expected"), money_("total"), money_("difference"), "inputs", "status")


_C = _CENTS.format
QUERIES = {
    f.__name__: f
    for f in (
        locale_parse_totals, parse_point_decimal, parse_comma_decimal, parse_space_nbsp, parse_apostrophe, parse_parentheses_negative, parse_currency_percent, parse_error_kinds, ambiguous_numbers,
        scale_thousands, footnote_split, missing_markers, date_parse_orders, date_ambiguity, date_order_evidence, column_decimal_evidence, table_context_resolution, infer_column_types,
    )
}
ORACLES = {
    "parse_point_decimal": _LINES_SQL, "parse_comma_decimal": _LINES_SQL, "parse_space_nbsp": _ORDERS_SQL, "parse_apostrophe": _ORDERS_SQL,
    "locale_parse_totals": f"""
with l as (select l_orderkey table_id, l_partkey % 17 = 0 gone, {_C('l_extendedprice')} c from lineitem),
t as (select table_id, sum(c) filter (not gone) s, count(*) filter (not gone) inputs from l group by 1)
select table_id, (coalesce(s, 0) + if(table_id % 10 = 0, 100, 0))::double / 100::double expected, s::double / 100::double total,
  if(table_id % 10 = 0 and s is not null, 1, if(s is null, null, 0))::double difference, inputs,
  case when inputs = 0 then 'notApplicable' when table_id % 10 = 0 then 'failed' else 'passed' end status
from t""",
    "parse_parentheses_negative": "select c_custkey, cast(round(c_acctbal * 100) as bigint) / 100.0::double amount, c_acctbal < 0 parentheses from customer",
    "parse_currency_percent": f"""
select l_orderkey, l_linenumber, cast({_C('l_discount')} as varchar) percent, true is_percent,
  concat(if(l_linenumber % 3 = 2, '-', ''), {_TEXT.format(_C('l_extendedprice'))}) amount,
  case l_linenumber % 3 when 0 then '€' when 1 then 'CHF' else '$' end currency
from lineitem""",
    "parse_error_kinds": """
select p_partkey, case p_size % 8 when 0 then 'empty' when 1 then 'notNumeric' when 2 then 'multipleDecimalSeparators' when 3 then 'invalidGrouping' when 4 then 'empty'
    when 6 then 'invalidGrouping' end as error,
  case p_size % 8 when 5 then cast(p_partkey as varchar) when 7 then concat(p_partkey, '.5') end canonical
from part""",
    "ambiguous_numbers": f"""
select o_orderkey, w between 1000 and 999999 ambiguous, cast(w as varchar) with_point,
  case when w < 1000 then cast(w as varchar) when w < 1000000 then concat(w // 1000, '.', lpad(cast(w % 1000 as varchar), 3, '0')) end with_comma
from (select o_orderkey, {_C('o_totalprice')} // 100 w from orders)""",
    "scale_thousands": f"""
select p_partkey, cast(c * 10 as double) units,
  rtrim(rtrim(concat(c // 100000, '.', lpad(cast(c % 100000 as varchar), 5, '0')), '0'), '.') thousands
from (select p_partkey, {_C('p_retailprice')} c from part)""",
    "footnote_split": f"""
select l_orderkey, l_linenumber, replace(concat(format('{{:,}}', c // 100), '.', lpad(cast(c % 100 as varchar), 2, '0')), '_', '') as value,
  nullif(['', '*', '†', '(a)', '(12)', '¹²', '*†'][l_linenumber], '') marker
from (select l_orderkey, l_linenumber, {_C('l_extendedprice')} c from lineitem)""",
    "missing_markers": """
select event_id, case when event_id % 7 = 2 then 'empty' when event_id % 2 = 1 then 'value' when event_id % 7 in (0, 1, 3, 4) then 'missing' else 'value' end kind,
  case when event_id % 2 = 1 then null else case event_id % 7 when 0 then '-' when 1 then 'n/a' when 3 then '…' when 4 then '-' end end token
from events""",
    "date_parse_orders": """
select o_orderkey, if(o_orderkey % 6 = 5, 'invalid', 'value') kind,
  case o_orderkey % 6 when 2 then strftime(o_orderdate, '%Y-%m') when 4 then strftime(o_orderdate, '%Y') when 5 then null else strftime(o_orderdate, '%Y-%m-%d') end iso
from orders""",
    "date_ambiguity": """
select o_orderkey, if(day(o_orderdate) <= 12 and day(o_orderdate) != month(o_orderdate), 'ambiguous', 'value') kind,
  if(day(o_orderdate) <= 12 and day(o_orderdate) != month(o_orderdate), null, strftime(o_orderdate, '%Y-%m-%d')) iso
from orders""",
    "date_order_evidence": """
select o_custkey table_id, if(bool_or(day(o_orderdate) > 12), 'dmy', 'auto') date_order, if(bool_or(day(o_orderdate) > 12), 'columnEvidence', 'unresolved') date_resolution
from orders group by 1""",
    "column_decimal_evidence": f"""
with x as (select l_suppkey table_id, l_linenumber n, {_C('l_extendedprice')} // 100 w from lineitem),
k as (select table_id, count(*) filter (n = 1 or (n = 7 and w >= 1000000)) as point, count(*) filter (n between 2 and 6) as comma from x group by 1)
select table_id, point, comma, case when point > 0 and point >= 4 * comma then '.' when comma > 0 and comma >= 4 * point then ',' end "decimal",
  case when point > 0 and point >= 4 * comma then point - comma when comma > 0 and comma >= 4 * point then comma - point end weight
from k""",
    "table_context_resolution": f"""
with x as (select l_orderkey t, {_C('l_extendedprice')} // 100 w from lineitem),
k as (select t, count(*) n, count(*) filter (w >= 1000000) big from x group by 1),
e as (select t, case when t % 3 = 0 then '.' when t % 3 = 1 then ',' when big > 0 then '.' end own0, if(big > 0, '.', null) own1, if(t % 3 = 0 or t % 3 = 2, if(t % 3 = 0, n, big), 0) + big p, if(t % 3 = 1, n, 0) q from k),
f as (select *, case when p > 0 and p >= 4 * q then '.' when q > 0 and q >= 4 * p then ',' end of_table from e)
select t table_id, 0 col, coalesce(own0, of_table) "decimal", case when own0 is not null then 'columnEvidence' when of_table is not null then 'tableEvidence' else 'unresolved' end resolution from f
union all select t, 1, coalesce(own1, of_table), case when own1 is not null then 'columnEvidence' when of_table is not null then 'tableEvidence' else 'unresolved' end from f""",
    "infer_column_types": """
select * from (values ('nation', 'key', 'identifier'), ('nation', 'name', 'text'), ('part', 'price', 'decimal'), ('part', 'cost', 'currency'), ('part', 'size', 'integer'), ('part', 'sku', 'identifier'), ('part', 'brand', 'text'),
  ('orders', 'day', 'date'), ('orders', 'total', 'decimal'), ('orders', 'year', 'integer'), ('orders', 'postcode', 'identifier'), ('orders', 'share', 'percent')) t(table_id, header, type)""",
}
