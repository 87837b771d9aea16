"""Column functions over whole tables."""

from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright import operators as op

from .registry import query, rounded


@query("""
select p_partkey, upper(p_name) as upper, lower(p_brand) as lower,
  array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title,
  regexp_replace(regexp_replace('  ' || p_name || chr(9), '^\\s+', ''), '\\s+$', '') as trimmed,
  substr(p_name, 1, 3) as head, substr(p_name, 3) as tail, length(p_name)::int as size,
  string_split(p_name, ' ')[1] as piece, string_split(p_name, ' ')[-1] as last_piece, null::varchar as no_piece,
  p_type = 'PROMO' as eq, contains(p_name, 'red') as has, starts_with(p_name, 'blue') as starts, ends_with(p_name, 'bolt') as ends,
  lower(p_type) = 'promo' as eq_ci, contains(lower(p_name), 'red') as has_ci, starts_with(lower(p_brand), 'brand#1') as starts_ci,
  ends_with(lower(p_brand), '#1') as ends_ci, p_name || '-' || p_size as label
from part
""")
def fn_string(t):
    return op.derive(
        t.part,
        {
            "upper": fn.upper("p_name"), "lower": fn.lower("p_brand"), "title": fn.titlecase("p_name"),
            "trimmed": fn.trim(F.concat(F.lit("  "), "p_name", F.lit("\t"))), "head": fn.substring("p_name", -4, 3),
            "tail": fn.substring("p_name", 2), "size": fn.length("p_name"), "piece": fn.split("p_name", " "),
            "last_piece": fn.split("p_name", " ", -1), "no_piece": fn.split("p_name", " ", 9),
            "eq": fn.equals("p_type", "PROMO"), "has": fn.contains("p_name", "red"),
            "starts": fn.starts_with("p_name", "blue"), "ends": fn.ends_with("p_name", "bolt"),
            "eq_ci": fn.equals_ci("p_type", "Promo"), "has_ci": fn.contains_ci("p_name", "RED"),
            "starts_ci": fn.starts_with_ci("p_brand", "BRAND#1"), "ends_ci": fn.ends_with_ci("p_brand", "#1"),
            "label": fn.concat("p_name", F.lit("-"), "p_size"),
        },
    ).drop("p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("""
select o_orderkey, coalesce(nullif(o_orderstatus, 'P') = 'F', false) as eq, coalesce(contains(nullif(o_orderstatus, 'P'), 'F'), false) as has,
  upper(nullif(o_orderstatus, 'P')) as up, length(nullif(o_orderstatus, 'P'))::int as size from orders
""")
def fn_string_nulls(t):
    o = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    return op.derive(
        o, {"eq": fn.equals("s", "F"), "has": fn.contains("s", "F"), "up": fn.upper("s"), "size": fn.length("s")}
    ).drop("s")


@query("""
select page_id, regexp_matches(url, '(?i)EXAMPLE\\.com') as matches,
  case when regexp_matches(url, '/([a-z]{2})/(\\d+)') then regexp_extract(url, '/([a-z]{2})/(\\d+)', 2) end as number,
  case when regexp_matches(url, 'ref=(\\w+)') then regexp_extract(url, 'ref=(\\w+)', 1) end as ref,
  regexp_replace(url, '([a-z]+)\\.example', '\\1.site', 'g') as moved, regexp_replace(url, '[aeiou]', '', 'g') as short
from pages
""")
def fn_regex(t):
    return op.derive(
        t.pages.select("page_id", "url"),
        {
            "matches": fn.regexp_match("url", r"(?i)EXAMPLE\.com"),
            "number": fn.regexp_extract("url", r"/([a-z]{2})/(\d+)", 2), "ref": fn.regexp_extract("url", r"ref=(\w+)", 1),
            "moved": fn.regexp_replace("url", r"([a-z]+)\.example", "$1.site"), "short": fn.regexp_replace("url", "[aeiou]", None),
        },
    ).drop("url")


@query("""
select event_id, year(ts)::int as y, month(ts)::int as m, day(ts)::int as d, hour(ts)::int as h, minute(ts)::int as mi, second(ts)::int as s,
  (isodow(ts) - 1)::int as wd, week(ts)::int as w, quarter(ts)::int as q, date_diff('day', timestamp '2024-01-10', date_trunc('day', ts))::int as age,
  date_trunc('year', ts)::date as ty, date_trunc('quarter', ts)::date as tq, date_trunc('month', ts)::date as tm,
  date_trunc('week', ts)::date as tw, date_trunc('day', ts)::date as td, date_trunc('hour', ts) as th,
  time_bucket(interval 15 minutes, ts) as t15, date_trunc('day', ts) + to_hours((hour(ts) // 4 * 4)::int) as t4h,
  strftime(ts, '%d/%m/%y %H:%M:%S') as shown
from events
""")
def fn_date(t):
    return op.derive(
        t.events.select("event_id", "ts"),
        {
            "y": fn.year("ts"), "m": fn.month("ts"), "d": fn.day("ts"), "h": fn.hour("ts"), "mi": fn.minute("ts"),
            "s": fn.second("ts"), "wd": fn.weekday("ts"), "w": fn.week("ts"), "q": fn.quarter("ts"),
            "age": fn.days_between(F.lit("2024-01-10"), "ts"),
            "ty": fn.date_trunc("ts", "year"), "tq": fn.date_trunc("ts", "quarter"), "tm": fn.date_trunc("ts", "month"),
            "tw": fn.date_trunc("ts", "week"), "td": fn.date_trunc("ts", "day"), "th": fn.date_trunc("ts", "hour"),
            "t15": fn.date_trunc("ts", "minute", 15), "t4h": fn.date_trunc("ts", "hour", 4),
            "shown": fn.format_date("ts", "DD/MM/YY HH:mm:ss"),
        },
    ).drop("ts")


@query("""
select o_orderkey, o_orderdate::date + 30 as plus_days, o_orderdate::date - 7 as minus_days,
  (date_trunc('month', o_orderdate) + interval 1 month)::date + day(o_orderdate)::int - 1 as plus_month,
  (date_trunc('month', o_orderdate) - interval 1 month)::date + day(o_orderdate)::int - 1 as minus_month,
  (date_trunc('month', o_orderdate) + interval 2 year)::date + day(o_orderdate)::int - 1 as plus_years,
  o_orderdate + interval 36 hour as plus_hours, o_orderdate - interval 90 minute as minus_minutes, o_orderdate + interval 45 second as plus_seconds
from orders
""")
def fn_date_add(t):
    return op.derive(
        t.orders.select("o_orderkey", "o_orderdate"),
        {
            "plus_days": fn.date_add("o_orderdate", 30, "days"), "minus_days": fn.date_add("o_orderdate", -7, "day"),
            "plus_month": fn.date_add("o_orderdate", 1, "month"), "minus_month": fn.date_add("o_orderdate", -1, "months"),
            "plus_years": fn.date_add("o_orderdate", 2, "years"), "plus_hours": fn.date_add("o_orderdate", 36, "hours"),
            "minus_minutes": fn.date_add("o_orderdate", -90, "minutes"), "plus_seconds": fn.date_add("o_orderdate", 45, "seconds"),
        },
    ).drop("o_orderdate")


@query("""
select o_orderkey, o_orderdate::date as iso, o_orderdate::date as slashed, o_orderdate::date as short_year,
  date_trunc('day', o_orderdate) + interval 14 hour as with_time, year(o_orderdate)::int as y, null::date as bad
from orders
""")
def fn_parse_date(t):
    def shown(pattern):
        return F.date_format("o_orderdate", pattern)

    return op.derive(
        t.orders.select("o_orderkey", "o_orderdate"),
        {
            "iso": fn.parse_date(shown("yyyy-MM-dd"), "YYYY-MM-DD"), "slashed": fn.parse_date(shown("M/d/yyyy"), "M/D/YYYY"),
            "short_year": fn.parse_date(shown("dd.MM.yy"), "DD.MM.YY"),
            "with_time": fn.parse_date(F.concat(shown("yyyy-MM-dd"), F.lit(" 14:00")), "YYYY-MM-DD HH:mm"),
            "y": fn.year(shown("M/d/yyyy")), "bad": fn.parse_date(shown("yyyy-MM-dd"), "DD/MM/YYYY"),
        },
    ).drop("o_orderdate")


@query("""
select event_id, round(abs(value - 50), 6) as a, round(pow(value, 2), 6) as p, round(sqrt(value), 6) as sq,
  case when value >= 50 then round(sqrt(greatest(value - 50, 0)), 6) end as sq_neg, round(cbrt(value), 6) as cb,
  round(exp(value / 100), 6) as ex, case when value > 0 then round(ln(greatest(value, 0.001)), 6) end as l,
  case when value > 0 then round(log10(greatest(value, 0.001)), 6) end as l10, case when value > 0 then round(log2(greatest(value, 0.001)), 6) end as l2,
  round(sin(value), 6) as si, round(cos(value), 6) as co, round(tan(value), 4) as ta, round(atan(value), 6) as at, round(atan2(value, 3), 6) as at2,
  case when value <= 1 then round(asin(least(value, 1)), 6) end as asi, case when value <= 1 then round(acos(least(value, 1)), 6) end as aco,
  round(radians(value), 6) as ra, round(degrees(value), 6) as de, sign(value - 50)::double as sg, trunc(value - 50)::double as tr,
  floor(value - 50)::double as fl, ceil(value - 50)::double as ce, floor((value - 50) * 10 + 0.5) / 10 as rd,
  floor(value / 2 + 0.5)::double as r0, least(value, 20.0) as lo, greatest(value, user_id)::double as hi,
  round(pi(), 6) as pi, round(exp(1), 6) as e, case when value > 0 then round(100 / nullif(value, 0), 6) end as di, round((value - 50) % 7, 6) as mo
from events
""")
def fn_math(t):
    out = op.derive(
        t.events.select("event_id", "value", "user_id"),
        {
            "a": fn.abs_(F.col("value") - 50), "p": fn.pow_("value", 2), "sq": fn.sqrt("value"), "sq_neg": fn.sqrt(F.col("value") - 50),
            "cb": fn.cbrt("value"), "ex": fn.exp(F.col("value") / 100), "l": fn.ln("value"), "l10": fn.log10("value"), "l2": fn.log2("value"),
            "si": fn.sin("value"), "co": fn.cos("value"), "ta": F.round(fn.tan("value"), 4), "at": fn.atan("value"), "at2": fn.atan2("value", 3),
            "asi": fn.asin("value"), "aco": fn.acos("value"), "ra": fn.radians("value"), "de": fn.degrees("value"),
            "sg": fn.sign(F.col("value") - 50), "tr": fn.trunc(F.col("value") - 50), "fl": fn.floor(F.col("value") - 50),
            "ce": fn.ceil(F.col("value") - 50), "rd": fn.round_(F.col("value") - 50, 1), "r0": fn.round_(F.col("value") / 2),
            "lo": fn.min_("value", 20), "hi": fn.max_("value", "user_id"), "pi": fn.pi(), "e": fn.e(),
            "di": fn.divide(100, "value"), "mo": fn.mod(F.col("value") - 50, 7),
        },
    )
    six = ("a", "p", "sq", "sq_neg", "cb", "ex", "l", "l10", "l2", "si", "co", "at", "at2", "asi", "aco", "ra", "de", "pi", "e", "di", "mo")
    return rounded(out, 6, *six).drop("value", "user_id")


@query("""
select p_partkey, regexp_extract(p_brand, '[0-9]+')::bigint as n, regexp_extract(p_brand, '[0-9]+')::double + 0.5 as x, null::bigint as no_n,
  true as is_word, false as is_number, case when p_size > 25 then 'big' else 'small' end as class,
  coalesce(nullif(p_type, 'PROMO'), 'none') as kind, nullif(p_type, 'PROMO') is null as same, nullif(p_type, 'PROMO') is distinct from 'SMALL' as differs,
  not coalesce(nullif(p_type, 'PROMO') = 'SMALL', false) as negated
from part
""")
def fn_type(t):
    number = fn.regexp_extract("p_brand", "[0-9]+")
    kind = F.nullif(F.col("p_type"), F.lit("PROMO"))
    return op.derive(
        t.part,
        {
            "n": fn.parse_int(F.concat(F.lit(" "), number, F.lit("abc"))), "x": fn.parse_float(F.concat(number, F.lit(".5kg"))),
            "no_n": fn.parse_int("p_brand"), "is_word": fn.is_nan("p_brand"), "is_number": fn.is_nan(number),
            "class": fn.if_(F.col("p_size") > 25, "big", "small"), "kind": fn.coalesce(kind, F.lit("none")),
            "same": fn.eq(kind, F.lit(None)), "differs": fn.ne(kind, F.lit("SMALL")), "negated": fn.not_(kind == "SMALL"),
        },
    ).drop("p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("""
select event_id, true as ok, false as bad, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.k')::bigint as kn,
  'k' as keys, 'object' as kind, 'array' as list_kind, 2 as list_size, event_type as second, '"' || event_type || '"' as quoted,
  '{"type":"' || event_type || '","user":' || user_id || '}' as made
from events
""")
def fn_json(t):
    pair = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(', {"a": "'), F.col("event_type"), F.lit('"}]'))
    return op.derive(
        t.events,
        {
            "ok": fn.is_json("props"), "bad": fn.is_json("event_type"), "k": fn.json_extract("props", "k"),
            "kn": fn.json_extract("props", "k", "bigint"), "keys": F.array_join(fn.json_keys("props"), ","),
            "kind": fn.json_type("props"), "list_kind": fn.json_type(pair), "list_size": fn.json_array_length(pair),
            "second": fn.json_extract(pair, "1.a"), "quoted": fn.json_stringify("event_type"),
            "made": fn.json_stringify(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")), nested=True),
        },
    ).drop("ts", "user_id", "event_type", "value", "props")


@query("select event_id, date_diff('day', ts::date, current_date)::int as age, true as now_is_today, ts < now()::timestamp as passed from events")
def fn_today_now(t):
    return t.events.select(
        "event_id", fn.days_between("ts", fn.today()).alias("age"), (F.to_date(fn.now()) == fn.today()).alias("now_is_today"), (F.col("ts") < fn.now()).alias("passed"),
    )
