"""Function names that other engines use, in Spark's terms. All stay built-in expressions; none becomes a UDF."""

from __future__ import annotations

from quarrel.plans import sqltext

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _gcd(a: str, b: str) -> str:
    """Euclid's steps; 100 are enough for 64 bits."""
    step = "(s, i) -> CASE WHEN s.y = 0 THEN s ELSE named_struct('x', s.y, 'y', s.x % s.y) END"
    return f"aggregate(sequence(1, 100), named_struct('x', abs(cast({a} AS bigint)), 'y', abs(cast({b} AS bigint))), {step}, s -> s.x)"


def _date_bin(args: list[str]) -> str:
    """``date_bin(INTERVAL, time[, origin])`` for intervals up to weeks."""
    words = args[0].lower().replace("'", " ").split()
    seconds = sum(int(n) * _UNIT_SECONDS[u.rstrip("s")] for n, u in zip(words[1::2], words[2::2], strict=False))
    origin = f"unix_timestamp({args[2]})" if len(args) > 2 else "0"
    return f"timestamp_seconds({origin} + floor((unix_timestamp({args[1]}) - {origin}) / {seconds}) * {seconds})"


def _trunc(args: list[str]) -> str:
    n = args[1] if len(args) > 1 else "0"
    return f"(sign({args[0]}) * floor(abs({args[0]}) * power(10, {n})) / power(10, {n}))"


def _digest(args: list[str]) -> str:
    kind = args[1].strip("'").lower()
    return f"unhex(md5({args[0]}))" if kind == "md5" else f"unhex(sha2({args[0]}, {kind.removeprefix('sha')}))"


def _encode(args: list[str]) -> str:
    kind = args[1].strip("'").lower()
    return {"hex": f"lower(hex({args[0]}))", "base64": f"base64(cast({args[0]} AS binary))"}.get(kind, f"encode({args[0]}, {args[1]})")


def _decode(args: list[str]) -> str:
    kind = args[1].strip("'").lower() if len(args) == 2 else ""
    return {"hex": f"unhex({args[0]})", "base64": f"unbase64({args[0]})"}.get(kind, f"decode({', '.join(args)})")


def _date_part(args: list[str]) -> str:
    kind = args[0].strip("'\"").lower()
    if kind == "dow":
        return f"(dayofweek({args[1]}) - 1)"
    if kind == "epoch":
        return f"unix_timestamp({args[1]})"
    return f"date_part({args[0]}, {args[1]})"


def _to_char(args: list[str]) -> str:
    """strftime patterns become Java's."""
    java = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh"}
    pattern = args[1]
    for a, b in java.items():
        pattern = pattern.replace(a, b)
    return f"date_format({args[0]}, {pattern})"


def _resize(args: list[str]) -> str:
    a, n, x = (*args, "NULL")[:3]
    return f"slice(concat({a}, array_repeat({x}, {n})), 1, {n})"


def _slice(args: list[str]) -> str:
    """Ends are 1-based and both in the slice; negative ends count from the back."""
    a, lo, hi = args[:3]
    at = lambda x: f"CASE WHEN {x} < 0 THEN size({a}) + {x} + 1 ELSE {x} END"
    return f"slice({a}, greatest({at(lo)}, 1), greatest(least({at(hi)}, size({a})) - greatest({at(lo)}, 1) + 1, 0))"


def _places(a: str, x: str, n: str) -> str:
    """Indexes of the first ``n`` elements that equal ``x``; null equals null."""
    return f"slice(filter(transform({a}, (v, i) -> if(v <=> {x}, i, null)), v -> v IS NOT NULL), 1, greatest({n}, 0))"


def _remove(args: list[str]) -> str:
    a, x, n = (*args, "1")[:3]
    return f"filter({a}, (v, i) -> NOT array_contains({_places(a, x, n)}, i))"


def _replace(args: list[str]) -> str:
    a, x, y, n = (*args, "1")[:4]
    return f"transform({a}, (v, i) -> if(array_contains({_places(a, x, n)}, i), {y}, v))"


#: Arrow's type names in Spark's terms; unsigned integers take the next wider type.
_ARROW = {
    "boolean": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint",
    "uint64": "decimal(20, 0)", "float32": "float", "float64": "double", "utf8": "string", "largeutf8": "string", "utf8view": "string", "binary": "binary", "date32": "date",
}


def _arrow_cast(args: list[str]) -> str:
    """``arrow_cast(x, 'Type')``; times with a zone are instants, times without one are local."""
    name = args[1].strip("'").replace(" ", "").lower()
    if name.startswith("decimal128("):
        kind = name.replace("128", "")
    elif name.startswith("timestamp("):
        kind = "timestamp_ntz" if name.endswith(",none)") else "timestamp"
    elif name in _ARROW:
        kind = _ARROW[name]
    else:
        raise ValueError(f"arrow_cast: unknown type {args[1]}")
    return f"cast({args[0]} AS {kind})"


#: Engine names to Spark names, or to expressions of their arguments.
FUNCTIONS = {
    # conditional and math
    "iszero": lambda a: f"({a[0]} = 0)",
    "gcd": lambda a: _gcd(*a),
    "lcm": lambda a: f"(CASE WHEN {a[0]} = 0 OR {a[1]} = 0 THEN 0 ELSE abs(cast({a[0]} AS bigint) * cast({a[1]} AS bigint)) div {_gcd(*a)} END)",
    "trunc": _trunc,
    # strings
    "strpos": "instr",
    "substr_index": "substring_index",
    "starts_with": "startswith",
    "ends_with": "endswith",
    "to_hex": lambda a: f"lower(hex({a[0]}))",
    "sha224": lambda a: f"sha2({a[0]}, 224)",
    "sha256": lambda a: f"sha2({a[0]}, 256)",
    "sha384": lambda a: f"sha2({a[0]}, 384)",
    "sha512": lambda a: f"sha2({a[0]}, 512)",
    "digest": _digest,
    "encode": _encode,
    "decode": _decode,
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    # regular expressions
    "regexp_match": lambda a: f"regexp_extract_all({a[0]}, {a[1]}, 0)",
    # times
    "date_bin": _date_bin,
    "date_part": _date_part,
    "to_char": _to_char,
    "to_timestamp_seconds": "timestamp_seconds",
    "to_timestamp_millis": "timestamp_millis",
    "to_timestamp_micros": "timestamp_micros",
    "to_timestamp_nanos": lambda a: f"timestamp_micros(({a[0]} - pmod({a[0]}, 1000)) div 1000)",
    "to_unixtime": "unix_timestamp",
    "to_local_time": lambda a: f"cast({a[0]} AS timestamp_ntz)",
    "today": lambda a: "current_date()",
    # arrays
    "make_array": "array",
    "array_concat": "concat",
    "array_cat": "concat",
    "array_has": "array_contains",
    "array_has_any": "arrays_overlap",
    "array_has_all": lambda a: f"(size(array_except({a[1]}, {a[0]})) = 0)",
    "array_positions": lambda a: f"filter(transform({a[0]}, (v, i) -> if(v <=> {a[1]}, i + 1, null)), v -> v IS NOT NULL)",
    "array_any_value": lambda a: f"try_element_at(filter({a[0]}, v -> v IS NOT NULL), 1)",
    "array_remove": _remove,
    "array_remove_n": _remove,
    "array_remove_all": lambda a: f"filter({a[0]}, v -> NOT (v <=> {a[1]}))",
    "array_replace": _replace,
    "array_replace_n": _replace,
    "array_replace_all": lambda a: f"transform({a[0]}, v -> if(v <=> {a[1]}, {a[2]}, v))",
    "array_resize": _resize,
    "array_slice": _slice,
    "array_length": "size",
    "array_ndims": lambda a: f"regexp_count(typeof({a[0]}), 'array<')",
    "array_dims": lambda a: f"array(size({a[0]}))",
    "array_element": "try_element_at",
    "empty": lambda a: f"(size({a[0]}) = 0)",
    "array_empty": lambda a: f"(size({a[0]}) = 0)",
    "array_to_string": "array_join",
    "string_to_array": lambda a: f"split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))",
    "generate_series": "sequence",
    "array_pop_back": lambda a: f"slice({a[0]}, 1, greatest(size({a[0]}) - 1, 0))",
    "array_pop_front": lambda a: f"slice({a[0]}, 2, size({a[0]}))",
    "array_reverse": "reverse",
    # structs and maps
    "struct": "struct",
    "get_field": lambda a: f"{a[0]}[{a[1]}]",
    "make_map": "map_from_arrays",
    "map_extract": lambda a: f"array(try_element_at({a[0]}, {a[1]}))",
    # aggregates
    "var": "var_samp",
    "var_sample": "var_samp",
    "covar": "covar_samp",
    "approx_distinct": "approx_count_distinct",
    "approx_median": lambda a: f"approx_percentile({a[0]}, 0.5)",
    "approx_percentile_cont": "approx_percentile",
    "approx_percentile_cont_with_weight": lambda a: f"percentile({a[0]}, {a[2]}, cast({a[1]} AS bigint))",
    "arrow_typeof": "typeof",
    "arrow_cast": _arrow_cast,
}
#: Functions of arrays go by ``list_`` too, those that Spark has under the same name among them.
_SAME = ("append", "distinct", "except", "intersect", "max", "min", "position", "prepend", "repeat", "sort", "union")
FUNCTIONS |= {"list_" + k.removeprefix("array_"): v for k, v in FUNCTIONS.items() if k.startswith("array_")} | {f"list_{k}": f"array_{k}" for k in _SAME}
FUNCTIONS["string_to_list"] = FUNCTIONS["string_to_array"]


def rewrite(sql: str) -> str:
    """A statement with other engines' names and operators in Spark's terms."""
    sql = sqltext.rewrite_distinct_on(sqltext.rewrite_qualify(sqltext.rewrite_ordered_lists(sql)))
    sql = sqltext.rewrite_unnest(sqltext.rewrite_joins(sqltext.rewrite_extract_epoch(sql)))
    return sqltext.rewrite_calls(sqltext.rewrite_operators(sql), FUNCTIONS)
