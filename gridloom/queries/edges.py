"""The strict dialect where types, patterns and run-time values matter; each has the same value in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import tables
from gridloom.functions import strict as p

QUERIES = {}
c, lit = F.col, F.lit


def _table(name: str, table: str, key: str, columns: dict[str, tuple]) -> None:
    """columns: output name -> (function that builds the Column, its value in SQL)."""

    def build(spark, sf_dir):
        return getattr(tables(spark, sf_dir), table).select(key, *(made().alias(n) for n, (made, _) in columns.items()))

    QUERIES[f"fn_{name}"] = (build, f"SELECT {key}, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in columns.items()) + f" FROM {table}")


_time = lambda: c("o_orderdate") + F.make_dt_interval(lit(0), F.pmod("o_orderkey", lit(24)).cast("int"), F.pmod("o_orderkey", lit(60)).cast("int"), lit(7.25))
_TIME = "(o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR + (o_orderkey % 60) * INTERVAL 1 MINUTE + INTERVAL 7250 MILLISECOND)"
_write = lambda pattern: lambda: p("format_datetime", _time(), pattern)
_mysql = lambda pattern: lambda: p("date_format", _time(), pattern)
_table("datetime_patterns", "orders", "o_orderkey", {
    "year_of_era": (_write("YYYY-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
    "short_year": (_write("yy/M/d"), "strftime(o_orderdate, '%y/%-m/%-d')"),
    "week": (_write("xxxx-'W'ww-e"), "strftime(o_orderdate, '%G-W%V-%u')"),
    "short_week_year": (_write("xx w"), "substr(strftime(o_orderdate, '%G'), 3) || ' ' || weekofyear(o_orderdate)"),
    "century": (_write("CC"), "(year(o_orderdate) // 100)::VARCHAR"),
    "names": (_write("EEE EEEE MMM MMMM"), "strftime(o_orderdate, '%a %A %b %B')"),
    "day_of_year": (_write("DDD"), "strftime(o_orderdate, '%j')"),
    "time": (_write("HH:mm:ss.SSS"), f"strftime({_TIME}, '%H:%M:%S.%g')"),
    "half_day": (_write("hh 'o''clock' a"), f"strftime({_TIME}, '%I') || ' o''clock ' || strftime({_TIME}, '%p')"),
    "from_one": (_write("kk"), f"lpad((CASE WHEN hour({_TIME}) = 0 THEN 24 ELSE hour({_TIME}) END)::VARCHAR, 2, '0')"),
    "from_zero": (_write("KK"), f"lpad((hour({_TIME}) % 12)::VARCHAR, 2, '0')"),
    "offset_": (_write("ZZ"), "'+00:00'"),
    "mysql_week": (_mysql("%x-%v"), "strftime(o_orderdate, '%G-%V')"),
    "mysql_time": (_mysql("%T %r"), f"strftime({_TIME}, '%H:%M:%S %I:%M:%S %p')"),
    "mysql_names": (_mysql("%W, %M %e %Y (%j) %%"), "strftime(o_orderdate, '%A, %B %-d %Y (%j) %%')"),
    "read": (lambda: p("parse_datetime", F.date_format(_time(), "yyyy-MM-dd HH:mm"), "YYYY-MM-dd HH:mm"), f"date_trunc('minute', {_TIME})"),
    "read_week": (
        lambda: p("parse_datetime", p("format_datetime", _time(), "xxxx-'W'ww-e HH:mm"), "xxxx-'W'ww-e HH:mm"), f"date_trunc('minute', {_TIME})"),
    "read_mysql_week": (lambda: F.to_date(p("date_parse", p("date_format", _time(), "%x %v"), "%x %v")), "CAST(date_trunc('week', o_orderdate) AS DATE)"),
})
_amount = lambda: c("o_totalprice") - lit(1000.5)
_cents = lambda: c("o_totalprice").cast("decimal(12,2)")
_table("rounding_types", "orders", "o_orderkey", {
    **{f"{n}_long": (lambda n=n: p(n, c("o_orderkey")), "o_orderkey") for n in ("ceil", "ceiling", "floor")},
    **{f"{n}_long_type": (lambda n=n: F.typeof(p(n, c("o_orderkey"))), "'bigint'") for n in ("ceil", "floor", "sign")},
    **{f"{n}_byte_type": (lambda n=n: F.typeof(p(n, F.pmod("o_orderkey", lit(9)).cast("tinyint"))), "'tinyint'") for n in ("ceil", "floor", "sign")},
    **{f"{n}_real_type": (lambda n=n: F.typeof(p(n, _amount())), "'double'") for n in ("ceil", "floor", "sign")},
    "ceil_real": (lambda: p("ceil", _amount()), "ceil(o_totalprice - 1000.5)"),
    "floor_real": (lambda: p("floor", -_amount()), "floor(1000.5 - o_totalprice)"),
    "ceil_near": (lambda: p("ceil", -_amount() / 1e9), "ceil((1000.5 - o_totalprice) / 1e9) + 0.0"),
    "ceil_cents": (lambda: p("ceil", _cents()).cast("double"), "ceil(o_totalprice::DECIMAL(12,2))::DOUBLE"),
    "floor_cents": (lambda: p("floor", _cents()).cast("double"), "floor(o_totalprice::DECIMAL(12,2))::DOUBLE"),
    "sign_long": (lambda: p("sign", c("o_orderkey") - 50), "sign(o_orderkey - 50)::BIGINT"),
    "sign_real": (lambda: p("sign", _amount()), "sign(o_totalprice - 1000.5)::DOUBLE"),
    "power_": (lambda: p("pow", F.pmod("o_orderkey", lit(9)).cast("double"), lit(2.0)), "pow(o_orderkey % 9, 2)"),
    "most": (lambda: p("infinity") > c("o_totalprice"), "true"),
    "cast_": (lambda: p("cast", c("o_orderkey"), "string"), "o_orderkey::VARCHAR"),
    "first_known": (lambda: p("coalesce", F.nullif("o_orderstatus", lit("F")), lit("none")), "coalesce(nullif(o_orderstatus, 'F'), 'none')"),
    "today": (lambda: p("current_date") >= lit("2020-01-01").cast("date"), "true"),
    "made": (lambda: p("array_constructor", c("o_orderkey"), c("o_custkey")), "[o_orderkey, o_custkey]"),
    "real_sum": (lambda: p("array_sum_double", F.array(c("o_totalprice"), lit(None).cast("double"), lit(1.0))), "o_totalprice + 1"),
    "field": (lambda: p("row_constructor", c("o_orderkey"), c("o_custkey")).getField("c2"), "o_custkey"),
    "zipped": (lambda: F.size(p("zip", F.array("o_orderkey"), F.array("o_custkey", "o_orderkey"))), "2"),
    "tried": (lambda: p("try", c("o_orderkey") / F.pmod("o_orderkey", lit(2))), "CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey::DOUBLE END"),
    "tried_cast": (lambda: p("try", c("o_orderstatus").cast("int")), "CAST(NULL AS INTEGER)"),
})
_table("url_parts", "pages", "page_id", {
    "protocol": (lambda: p("url_extract_protocol", c("url")), "regexp_extract(url, '^([a-z]+):', 1)"),
    "host": (lambda: p("url_extract_host", c("url")), "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"),
    "path": (lambda: p("url_extract_path", c("url")), "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"),
    "query": (lambda: p("url_extract_query", c("url")), "regexp_extract(url, '[?]([^#]*)', 1)"),
    "fragment": (lambda: p("url_extract_fragment", c("url")), "regexp_extract(url, '#(.*)$', 1)"),
    "port": (lambda: p("url_extract_port", c("url")), "nullif(regexp_extract(url, '^[a-z]+://[^/?#:]*:([0-9]+)', 1), '')::BIGINT"),
    "back": (lambda: p("url_decode", p("url_encode", c("url"))), "url"),
    "page": (lambda: p("url_extract_parameter", c("url"), lit("page")), "nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')"),
})
_table("json_parts", "events", "event_id", {
    "k": (lambda: p("json_extract_scalar", c("props"), "$.k"), "json_extract_string(props, '$.k')"),
    "whole": (lambda: p("json_format", p("json_parse", c("props"))), "replace(props, ' ', '')"),
    "count": (lambda: p("json_array_length", F.concat(lit("["), "props", lit(", 1, 2]"))), "3"),
    "has": (lambda: p("json_array_contains", F.concat(lit("["), c("event_id").cast("string"), lit(", 5]")), c("event_id")), "true"),
    "scalar": (lambda: p("is_json_scalar", c("event_id").cast("string")), "true"),
    "pairs": (lambda: F.element_at(p("split_to_map", F.concat(lit("a="), "event_type", lit(";b="), c("event_id").cast("string")), lit(";"), lit("=")), "b"), "event_id::VARCHAR"),
    "similar": (
        lambda: F.round(p("cosine_similarity", F.create_map(lit("a"), c("value"), lit("b"), lit(2.0)), F.create_map(lit("a"), lit(3.0), lit("c"), lit(1.0))), 8),
        "round(3 * value / sqrt((value * value + 4) * 10), 8)",
    ),
})
