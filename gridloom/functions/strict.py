"""The strict dialect: checked arithmetic, nulls in give null out, out-of-range look-ups give null.

``strict("split_part", F.col("s"), F.lit("-"), F.lit(1))`` builds a Column. Builders take Columns, and where the
dialect asks for constants (formats, lambdas) plain Python values. Everything stays in the JVM except functions of
``gridloom.functions.udfs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import patterns, udfs
from gridloom.functions.catalyst import attempt

lit, col = F.lit, F.col
STRICT: dict[str, Callable[..., Column]] = {}


def strict(name: str, *arguments) -> Column:
    """The Column of a function of this dialect; the name isn't case-sensitive."""
    try:
        build = STRICT[name.lower()]
    except KeyError:
        raise ValueError(f"no such function: {name}") from None
    return build(*arguments)


def _define(**functions: Callable[..., Column]) -> None:
    STRICT.update({name.rstrip("_"): f for name, f in functions.items()})


def _fold(f: Callable[[Column, Column], Column], columns: tuple[Column, ...]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = f(out, c)
    return out


def _any_null(*columns: Column) -> Column:
    found = lit(False)
    for c in columns:
        found = found | c.isNull()
    return found


def _extreme(f: Callable[..., Column]) -> Callable[..., Column]:
    def build(*a: Column) -> Column:
        nan = lit(False)
        for c in a:
            nan = nan | F.coalesce(F.isnan(c.try_cast("double")), lit(False))
        return F.when(_any_null(*a), lit(None)).when(nan, F.raise_error(lit("Invalid argument to greatest or least: NaN"))).otherwise(f(*a))

    return build


def quoted(text: Column) -> Column:
    """A regular expression that matches the text itself."""
    return F.concat(lit("\\Q"), F.replace(text, lit("\\E"), lit("\\E\\\\E\\Q")), lit("\\E"))


# Arithmetic ---------------------------------------------------------------------------------------------------------
def _truncate(x: Column, digits: Column | None = None) -> Column:
    scale = lit(1.0) if digits is None else F.pow(lit(10.0), digits)
    scaled = x.cast("double") * scale
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("double") / scale


def _whole(x: Column, up: bool) -> Column:
    """The next whole number, of the type of ``x``: a byte as step doesn't widen it."""
    near, step = F.round(x, 0), lit(1).cast("tinyint")
    return F.when(near < x, near + step).otherwise(near) if up else F.when(near > x, near - step).otherwise(near)


def _sign(x: Column) -> Column:
    one = lit(1).cast("tinyint")
    return F.when(F.isnan(x.cast("double")), x).when(x > 0, one).when(x < 0, -one).otherwise(x)


def _wilson(sign: int) -> Callable[..., Column]:
    def build(successes: Column, trials: Column, z: Column) -> Column:
        n, p = trials.cast("double"), successes / trials.cast("double")
        return (p + z * z / (2 * n) + sign * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    return build


def _map_cosine(a: Column, b: Column) -> Column:
    total = lambda m: F.aggregate(F.map_values(m), lit(0.0), lambda s, v: s + v * v)
    dot = F.aggregate(F.map_keys(a), lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(a, k), lit(0.0)) * F.coalesce(F.try_element_at(b, k), lit(0.0)))
    return F.when(~_any_null(a, b), dot / F.sqrt(total(a) * total(b)))


_define(
    plus=lambda a, b: a + b, minus=lambda a, b: a - b, multiply=lambda a, b: a * b, mod=lambda a, b: a % b, negate=F.negative,
    divide=lambda a, b: a / b, integer_divide=lambda a, b: (a - a % b) / b,
    ceil=lambda x: _whole(x, up=True), ceiling=lambda x: _whole(x, up=True), floor=lambda x: _whole(x, up=False), abs=F.abs,
    radians=F.radians, degrees=F.degrees, round=lambda x, d=0: F.round(x, d), power=F.pow, pow=F.pow, exp=F.exp, ln=F.ln, log2=F.log2, log10=F.log10,
    clamp=lambda x, low, high: F.when(~_any_null(x, low, high), F.least(F.greatest(x, low), high)), cos=F.cos, cosh=F.cosh, acos=F.acos, sin=F.sin, asin=F.asin, tan=F.tan,
    tanh=F.tanh, atan=F.atan, atan2=F.atan2, sqrt=F.sqrt, cbrt=F.cbrt, sign=_sign, infinity=lambda: lit(float("inf")), nan=lambda: lit(float("nan")), e=F.e, pi=F.pi,
    is_finite=lambda x: ~F.isnan(x) & (F.abs(x) != lit(float("inf"))), is_infinite=lambda x: F.abs(x) == lit(float("inf")), is_nan=F.isnan, rand=F.rand,
    random=lambda n=None: F.rand() if n is None else F.floor(F.rand() * n).cast("bigint"), truncate=_truncate,
    width_bucket=lambda x, *a: F.width_bucket(x, *a) if len(a) == 3 else F.size(F.filter(a[0], lambda b: b <= x)).cast("bigint"),
    from_base=lambda s, base: F.conv(s, base, 10).cast("bigint"), to_base=lambda x, base: F.lower(F.conv(x.cast("string"), 10, base)),
    wilson_interval_lower=_wilson(-1), wilson_interval_upper=_wilson(1), cosine_similarity=_map_cosine, not_=lambda x: ~x,
    cauchy_cdf=lambda median, scale, x: 0.5 + F.atan((x - median) / scale) / F.pi(), laplace_cdf=lambda mean, scale, x: F.when(x < mean, 0.5 * F.exp((x - mean) / scale)).otherwise(1 - 0.5 * F.exp((mean - x) / scale)),
    weibull_cdf=lambda shape, scale, x: F.when(x <= 0, 0.0).otherwise(1 - F.exp(-F.pow(x / scale, shape))), poisson_cdf=udfs.poisson_cdf, normal_cdf=udfs.normal_cdf, beta_cdf=udfs.beta_cdf,
    binomial_cdf=udfs.binomial_cdf, chi_squared_cdf=udfs.chi_squared_cdf, f_cdf=udfs.f_cdf, gamma_cdf=udfs.gamma_cdf, inverse_beta_cdf=udfs.inverse_beta_cdf,
)

# Comparison and general ---------------------------------------------------------------------------------------------
_define(
    eq=lambda a, b: a == b, neq=lambda a, b: a != b, lt=lambda a, b: a < b, gt=lambda a, b: a > b, lte=lambda a, b: a <= b, gte=lambda a, b: a >= b,
    distinct_from=lambda a, b: ~a.eqNullSafe(b), between=lambda x, a, b: x.between(a, b), in_=lambda x, *a: x.isin(*a), row_constructor=lambda *a: F.struct(*(c.alias(f"c{i}") for i, c in enumerate(a, 1))),
    is_null=F.isnull, subscript=F.element_at, element_at=F.try_element_at, greatest=_extreme(F.greatest), least=_extreme(F.least), cardinality=F.cardinality,
    transform=F.transform, filter=F.filter, reduce=lambda a, start, step, end=None: F.aggregate(a, start, step, *([end] if end else [])),
)


def _switch(*arguments: Column) -> Column:
    """switch(condition, value, condition, value, ..., default): the value of the first condition that is true."""
    pairs, rest = arguments[: len(arguments) // 2 * 2], arguments[len(arguments) // 2 * 2 :]
    out = F.when(pairs[0], pairs[1])
    for condition, value in zip(pairs[2::2], pairs[3::2], strict=True):
        out = out.when(condition, value)
    return out.otherwise(rest[0]) if rest else out


def _try(x: Column | str, *arguments) -> Column:
    """``strict("try", column)``: null where working the column out is an error; or a function's name and its arguments."""
    return attempt(x if isinstance(x, Column) else strict(x, *arguments))


_define(
    and_=lambda *a: _fold(lambda x, y: x & y, a), or_=lambda *a: _fold(lambda x, y: x | y, a), if_=lambda c, a, b=None: F.when(c, a) if b is None else F.when(c, a).otherwise(b), switch=_switch, coalesce=F.coalesce,
    cast=lambda x, kind: x.cast(kind), try_cast=lambda x, kind: x.try_cast(kind), try_=_try,
)


# Arrays -------------------------------------------------------------------------------------------------------------
def _sum(a: Column, start: Column) -> Column:
    return F.aggregate(a, start, lambda s, x: s + F.coalesce(x, start))


def _position(a: Column, x: Column, instance: Column | None = None) -> Column:
    if instance is None:
        return F.array_position(a, x)
    places = F.filter(F.transform(a, lambda e, i: F.when(e == x, i + 1)), lambda p: p.isNotNull())
    return F.when(~_any_null(a, x, instance), F.coalesce(F.try_element_at(places, instance.cast("int")), lit(0)).cast("bigint"))


def _normalize(a: Column, p: Column) -> Column:
    norm = F.pow(F.aggregate(a, lit(0.0), lambda s, v: s + F.pow(F.abs(v), p)), 1 / p)
    return F.when(norm == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda v: v / norm))


def _ngrams(a: Column, n: Column) -> Column:
    return F.transform(F.sequence(lit(1), F.greatest(lit(1), F.size(a) - n + 1)), lambda i: F.slice(a, i, n))


def _runs(a: Column) -> Column:
    """Structs (e, n): each distinct element and how often it stands in the array, in order, nulls last; by one sort."""

    def of(ordered: Column) -> Column:
        starts = F.array_compact(F.transform(ordered, lambda e, i: F.when((i == 0) | ~e.eqNullSafe(F.get(ordered, i - 1)), i)))
        return _let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("e"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("n"))))

    return _let(F.array_sort(a), of)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _frequency(a: Column) -> Column:
    return _let(_runs(F.array_compact(a)), lambda found: F.map_from_arrays(F.transform(found, lambda r: r["e"]), F.transform(found, lambda r: r["n"])))


def _duplicates(a: Column) -> Column:
    return F.sort_array(F.transform(F.filter(_runs(a), lambda r: r["n"] > 1), lambda r: r["e"]))


_define(
    array_constructor=lambda *a: F.array(*a), array_min=lambda a: F.when(~F.exists(a, lambda e: e.isNull()), F.array_min(a)), array_max=lambda a: F.when(~F.exists(a, lambda e: e.isNull()), F.array_max(a)),
    array_join=F.array_join, array_has_duplicates=lambda a: F.size(F.array_distinct(a)) < F.size(a), array_frequency=_frequency, array_normalize=_normalize,
    trim_array=lambda a, n: F.slice(a, lit(1), F.size(a) - n), remove_nulls=F.array_compact, array_union=F.array_union, array_remove=F.array_remove, all_match=F.forall, any_match=F.exists,
    none_match=lambda a, f: ~F.exists(a, f), find_first=lambda a, f: F.get(F.filter(a, f), lit(0)), find_first_index=lambda a, f: F.nullif(F.array_position(F.transform(a, f), lit(True)), lit(0)),
    array_distinct=F.array_distinct, array_duplicates=_duplicates,
    array_intersect=F.array_intersect, contains=F.array_contains, array_except=F.array_except, arrays_overlap=F.arrays_overlap, slice=F.slice, zip=F.arrays_zip, zip_with=F.zip_with,
    array_position=_position, shuffle=F.shuffle, array_sort=F.array_sort, array_sort_desc=lambda a: F.sort_array(a, asc=False),
    array_sum=lambda a: _sum(a, lit(0).cast("bigint")), array_sum_double=lambda a: _sum(a, lit(0.0)),
    array_average=lambda a: F.when(F.size(F.array_compact(a)) > 0, _sum(a, lit(0.0)) / F.size(F.array_compact(a))), repeat=F.array_repeat, sequence=F.sequence, flatten=F.flatten, ngrams=_ngrams,
    combinations=udfs.combinations,
)

# Maps ---------------------------------------------------------------------------------------------------------------


def _first_entries(entries: Column) -> Column:
    """Entries whose key no earlier one has."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, lit(1), i), lambda d: d["key"] == e["key"]))


def _concat_maps(*maps: Column) -> Column:
    entries = F.concat(*(F.map_entries(m) for m in reversed(maps)))  # the last map wins
    return F.map_from_entries(_first_entries(entries))


def _multimap(entries: Column) -> Column:
    fields = F.transform(entries, lambda e: F.struct(e.getField("k").alias("key"), e.getField("v").alias("value")))
    keys = F.array_distinct(F.transform(fields, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(fields, lambda e: e["key"] == k), lambda e: e["value"])))


_define(
    map_filter=F.map_filter, transform_keys=F.transform_keys, transform_values=F.transform_values, map=lambda *a: F.map_from_arrays(*a) if a else F.map_from_arrays(F.array(), F.array()),
    map_entries=F.map_entries, map_from_entries=F.map_from_entries, map_keys=F.map_keys, map_values=F.map_values, map_zip_with=F.map_zip_with, map_concat=_concat_maps,
    all_keys_match=lambda m, f: F.forall(F.map_keys(m), f), any_keys_match=lambda m, f: F.exists(F.map_keys(m), f), no_keys_match=lambda m, f: ~F.exists(F.map_keys(m), f),
    any_values_match=lambda m, f: F.exists(F.map_values(m), f), no_values_match=lambda m, f: ~F.exists(F.map_values(m), f), multimap_from_entries=_multimap,
)

# Strings and regular expressions ------------------------------------------------------------------------------------


def _substr(s: Column, start: Column, length: Column | None = None) -> Column:
    size = F.length(s)
    at = F.when(start > 0, start).otherwise(size + start + 1)
    taken = F.substring(s, at, size) if length is None else F.substring(s, at, F.greatest(length, lit(0)))
    return F.when(_any_null(s, start, *([] if length is None else [length])), lit(None)).when((start == 0) | (at < 1) | (at > size), "").otherwise(taken)


def _strpos(s: Column, part: Column, instance: Column | None = None) -> Column:
    if instance is None:
        return F.call_function("instr", s, part).cast("bigint")
    pieces = F.split(s, quoted(part), -1)
    before = F.aggregate(F.slice(pieces, lit(1), instance), lit(0), lambda a, x: a + F.length(x))
    return F.when(F.size(pieces) > instance, before + (instance - 1) * F.length(part) + 1).otherwise(F.when(~_any_null(s, part, instance), 0)).cast("bigint")


def _strrpos(s: Column, part: Column) -> Column:
    back = F.call_function("instr", F.reverse(s), F.reverse(part))
    return F.when(back == 0, 0).otherwise(F.length(s) - back - F.length(part) + 2).cast("bigint")


def _codepoint(s: Column) -> Column:
    return F.when(F.length(s) != 1, F.raise_error(lit("codepoint takes a single character")).cast("int")).otherwise(F.ascii(s))


def _regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    return F.when(F.regexp_like(s, lit(pattern)), F.regexp_extract(s, pattern, group))


_define(
    chr=F.char, codepoint=_codepoint, levenshtein_distance=lambda a, b: F.levenshtein(a, b).cast("bigint"), length=lambda s: F.length(s).cast("bigint"), starts_with=F.startswith, ends_with=F.endswith,
    substr=_substr, split_part=lambda s, d, i: F.get(F.split(s, quoted(d), -1), (i - 1).cast("int")), trim=F.trim, ltrim=F.ltrim, rtrim=F.rtrim, lpad=lambda s, n, p: F.lpad(s, n, p), rpad=lambda s, n, p: F.rpad(s, n, p),
    like=lambda s, p, escape=None: F.like(s, p, *([escape] if escape is not None else [])), regexp_replace=lambda s, p, r="": F.regexp_replace(s, p, r), lower=F.lower, upper=F.upper,
    split=lambda s, d, n=None: F.split(s, quoted(d), -1 if n is None else n), split_to_map=lambda s, a, b: F.str_to_map(s, quoted(a), quoted(b)), concat=F.concat, replace=lambda s, a, b="": F.replace(s, a, lit(b) if isinstance(b, str) else b),
    reverse=F.reverse, to_utf8=lambda s: F.encode(s, "UTF-8"), from_utf8=lambda b: F.decode(F.encode(F.call_function("make_valid_utf8", b.cast("string")), "UTF-8"), "UTF-8"), regexp_extract=_regexp_extract,
    regexp_extract_all=lambda s, p, g=0: F.regexp_extract_all(s, lit(p), lit(g)), regexp_like=F.regexp_like, strpos=_strpos, strrpos=_strrpos,
)

# Binary -------------------------------------------------------------------------------------------------------------


def _unsigned(digits: int, bits: int, kind: str) -> Callable[[Column], Column]:
    """A big-endian two's complement number: the unsigned value folded below 2**(bits - 1)."""

    def build(b: Column) -> Column:
        value = F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")
        signed = F.when(value >= lit(str(2 ** (bits - 1))).cast("decimal(20,0)"), value - lit(str(2**bits)).cast("decimal(20,0)")).otherwise(value).cast(kind)
        return F.when(F.octet_length(b) != digits // 2, F.raise_error(lit(f"expects {digits // 2} bytes")).cast(kind)).otherwise(signed)

    return build


_define(
    crc32=lambda b: F.crc32(b).cast("bigint"), xxhash64=udfs.xxhash64, md5=lambda b: F.unhex(F.md5(b)), sha1=lambda b: F.unhex(F.sha1(b)), sha256=lambda b: F.unhex(F.sha2(b, 256)), sha512=lambda b: F.unhex(F.sha2(b, 512)),
    hmac_md5=udfs.hmac("md5"), hmac_sha1=udfs.hmac("sha1"), hmac_sha256=udfs.hmac("sha256"), hmac_sha512=udfs.hmac("sha512"), spooky_hash_v2_32=udfs.spooky(32), spooky_hash_v2_64=udfs.spooky(64),
    to_hex=F.hex, from_hex=F.unhex, to_base64=F.base64, from_base64=F.unbase64, to_base64url=lambda b: F.translate(F.base64(b), "+/", "-_"), from_base64url=lambda s: F.unbase64(F.translate(s, "-_", "+/")),
    from_big_endian_32=_unsigned(8, 32, "int"), to_big_endian_32=lambda x: F.unhex(F.right(F.lpad(F.hex(x.cast("bigint")), 16, "0"), lit(8))), from_big_endian_64=_unsigned(16, 64, "bigint"),
    to_big_endian_64=lambda x: F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0")), to_ieee754_32=udfs.ieee754(32), to_ieee754_64=udfs.ieee754(64),
)


# Bits ---------------------------------------------------------------------------------------------------------------
def _mask(bits: Column) -> Column:
    return F.when(bits >= 64, lit(-1).cast("bigint")).otherwise(F.call_function("shiftleft", lit(1).cast("bigint"), bits.cast("int")) - 1)


_shift = lambda name: lambda x, n: F.call_function(name, x.cast("bigint"), n.cast("int"))
_over = lambda x, n, made, past: F.when(n >= 64, past).otherwise(made)
_define(
    bitwise_and=lambda a, b: a.bitwiseAND(b), bitwise_or=lambda a, b: a.bitwiseOR(b), bitwise_xor=lambda a, b: a.bitwiseXOR(b), bitwise_not=F.bitwise_not,
    bit_count=lambda x, bits: F.bit_count(x.cast("bigint").bitwiseAND(_mask(bits))).cast("bigint"),
    bitwise_arithmetic_shift_right=lambda x, n: _over(x, n, _shift("shiftright")(x, n), F.when(x < 0, -1).otherwise(0)), bitwise_right_shift_arithmetic=lambda x, n: _over(x, n, _shift("shiftright")(x, n), F.when(x < 0, -1).otherwise(0)),
    bitwise_left_shift=lambda x, n: _over(x, n, _shift("shiftleft")(x, n), lit(0)), bitwise_right_shift=lambda x, n: _over(x, n, _shift("shiftrightunsigned")(x, n), lit(0)),
    bitwise_logical_shift_right=lambda x, n, bits: _over(x, n, _shift("shiftrightunsigned")(x.cast("bigint").bitwiseAND(_mask(bits)), n), lit(0)),
    bitwise_shift_left=lambda x, n, bits: _over(x, n, _shift("shiftleft")(x, n).bitwiseAND(_mask(bits)), lit(0)),
)

# Dates and times ----------------------------------------------------------------------------------------------------
def _unit(name: str) -> str:
    unit = name.upper()
    if unit not in ("MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"):
        raise ValueError(f"no such unit: {name}")
    return unit


def _date_add(unit: str, n: Column, x: Column) -> Column:
    unit = _unit(unit)
    zero = lit(0)
    if unit in ("YEAR", "QUARTER", "MONTH"):
        return x + F.make_ym_interval(zero, n * {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit])
    seconds = {"MILLISECOND": 0.001, "SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800}[unit]
    return x + F.make_dt_interval(zero, zero, zero, (n * lit(seconds)).cast("decimal(18,6)"))


def _date_diff(unit: str, a: Column, b: Column) -> Column:
    unit = _unit(unit)
    whole = {"MILLISECOND": 1_000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000, "WEEK": 604_800_000_000}
    if unit in whole:
        micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
        return _truncate(micros / whole[unit]).cast("bigint")
    return _truncate(_truncate(F.months_between(b, a, roundOff=False)) / {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]).cast("bigint")


_zone = lambda part, at, n: lambda x: F.substring(F.date_format(x, "xxx"), at, n).cast("int")
_iso = lambda x: (F.weekday(x) + 1).cast("bigint")
_big = lambda f: lambda x: f(x).cast("bigint")
_define(
    to_unixtime=lambda x: F.unix_micros(x.cast("timestamp")) / 1e6, from_unixtime=F.timestamp_seconds, date=F.to_date, timezone_hour=_zone("hour", 1, 3), timezone_minute=_zone("minute", 5, 2), year=_big(F.year),
    week=_big(F.weekofyear), week_of_year=_big(F.weekofyear), quarter=_big(F.quarter), month=_big(F.month), day=_big(F.dayofmonth), day_of_month=_big(F.dayofmonth), dow=_iso, day_of_week=_iso,
    doy=_big(F.dayofyear), day_of_year=_big(F.dayofyear), yow=lambda x: F.extract(lit("YEAROFWEEK"), x).cast("bigint"), year_of_week=lambda x: F.extract(lit("YEAROFWEEK"), x).cast("bigint"), hour=_big(F.hour),
    last_day_of_month=F.last_day, minute=_big(F.minute), second=_big(F.second), millisecond=lambda x: F.date_format(x, "SSS").cast("bigint"), date_trunc=lambda unit, x: F.date_trunc(unit, x),
    date_add=_date_add, date_diff=_date_diff, date_format=lambda x, f: patterns.write(x, patterns.percents(f)), format_datetime=lambda x, f: patterns.write(x, patterns.runs(f)),
    parse_datetime=lambda s, f: patterns.read(s, patterns.runs(f)), date_parse=lambda s, f: patterns.read(s, patterns.percents(f)), current_date=F.current_date,
)

# JSON and URLs ------------------------------------------------------------------------------------------------------


def _json_kind(text: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(text))


def _json_scalar(text: Column, path: str) -> Column:
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"), F.get_json_object(text, path))


def _json_contains(text: Column, value: Column) -> Column:
    each = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return F.exists(each, lambda v: F.try_variant_get(v, "$", "string").eqNullSafe(value.cast("string")))


def _json_size(text: Column, path: str) -> Column:
    part = F.get_json_object(text, path)
    return F.when(text.isNotNull(), F.coalesce(F.json_array_length(part), F.size(F.json_object_keys(part)), lit(0))).cast("bigint")


def _port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[^/?#]*//[^/?#]*:([0-9]+)(?:[/?#]|$)", 1), lit("")).cast("bigint")


_url = lambda part: lambda u: F.when(u.isNotNull(), F.coalesce(F.try_parse_url(u, lit(part)), lit("")))
_define(
    is_json_scalar=lambda s: ~_json_kind(s).startswith("OBJECT") & ~_json_kind(s).startswith("ARRAY"), json_extract_scalar=_json_scalar, json_extract=lambda s, p: F.to_json(F.try_variant_get(F.try_parse_json(s), p, "variant")),
    json_array_length=lambda s: F.json_array_length(s).cast("bigint"), json_array_contains=_json_contains, json_size=_json_size, json_format=lambda v: F.to_json(v), json_parse=lambda s: F.parse_json(s),
    url_extract_host=_url("HOST"), url_extract_fragment=_url("REF"), url_extract_path=_url("PATH"), url_extract_protocol=_url("PROTOCOL"), url_extract_query=_url("QUERY"),
    url_extract_parameter=lambda u, name: F.try_parse_url(u, lit("QUERY"), name), url_extract_port=_port, url_encode=F.url_encode, url_decode=F.url_decode,
    empty_approx_set=lambda: F.hll_sketch_agg(F.when(lit(False), lit(0))),
)
