"""The function packs as temporary SQL functions; bodies are SQL expressions that the optimiser sees through.

Call :func:`register` once per session. All are null on null unless they say otherwise. Places count from 1.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_HAVERSINE = "2 * 6371.0 * atan2(sqrt({h}), sqrt(greatest(0D, 1 - {h})))"
_H = "(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))"

#: signature -> return type, body
FUNCTIONS: dict[str, tuple[str, str]] = {
    # geo
    "geo_distance(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)": ("DOUBLE", _HAVERSINE.format(h=_H)),
    "geo_bbox_contains(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, lat DOUBLE, lon DOUBLE)": ("INT", "CAST(lat >= a AND lat <= b AND lon >= c AND lon <= d AS INT)"),
    "geo_within_radius(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, km DOUBLE)": ("INT", f"CAST({_HAVERSINE.format(h=_H)} <= km AS INT)"),
    # text: case, measure
    "text_upper(s STRING)": ("STRING", "upper(s)"),
    "text_lower(s STRING)": ("STRING", "lower(s)"),
    "text_title(s STRING)": ("STRING", "initcap(s)"),
    "text_casefold(s STRING)": ("STRING", "lower(s)"),
    "text_length(s STRING)": ("INT", "length(s)"),
    "text_size(s STRING)": ("INT", "octet_length(s)"),
    "text_bitsize(s STRING)": ("INT", "bit_length(s)"),
    # text: slice
    "text_substring(s STRING, start INT, n INT DEFAULT 2147483647)": ("STRING", "CASE WHEN n < 0 THEN NULL ELSE substring(s, greatest(start, 1), greatest(0, least(n, 2147483647) + least(start - 1, 0))) END"),
    "text_slice(s STRING, start INT, stop INT DEFAULT 2147483647)": (
        "STRING",
        "substring(s, CASE WHEN start < 0 THEN greatest(length(s) + start + 1, 1) ELSE greatest(start, 1) END, greatest(0, CASE WHEN stop < 0 THEN length(s) + stop + 1 ELSE least(stop, length(s) + 1) END - CASE WHEN start < 0 THEN greatest(length(s) + start + 1, 1) ELSE greatest(start, 1) END))",
    ),
    "text_left(s STRING, n INT)": ("STRING", "CASE WHEN n >= 0 THEN left(s, n) ELSE left(s, greatest(length(s) + n, 0)) END"),
    "text_right(s STRING, n INT)": ("STRING", "CASE WHEN n >= 0 THEN right(s, n) ELSE right(s, greatest(length(s) + n, 0)) END"),
    "text_split(s STRING, sep STRING, n INT)": ("STRING", "CASE WHEN n = 0 THEN '' ELSE split_part(s, sep, n) END"),
    # text: search
    "text_index(s STRING, other STRING)": ("INT", "instr(s, other)"),
    "text_last_index(s STRING, other STRING)": ("INT", "CASE WHEN instr(reverse(s), reverse(other)) = 0 THEN 0 ELSE length(s) - instr(reverse(s), reverse(other)) - length(other) + 2 END"),
    "text_contains(s STRING, other STRING)": ("INT", "CAST(contains(s, other) AS INT)"),
    "text_has_prefix(s STRING, other STRING)": ("INT", "CAST(startswith(s, other) AS INT)"),
    "text_has_suffix(s STRING, other STRING)": ("INT", "CAST(endswith(s, other) AS INT)"),
    "text_count(s STRING, other STRING)": ("INT", "CASE WHEN other = '' THEN 0 ELSE CAST((length(s) - length(replace(s, other, ''))) / length(other) AS INT) END"),
    "text_like(pattern STRING, s STRING)": ("INT", "CAST(s ILIKE pattern AS INT)"),
    # text: build, trim, pad
    "text_concat(a STRING, b STRING)": ("STRING", "concat(coalesce(a, ''), coalesce(b, ''))"),
    "text_join(sep STRING, parts ARRAY<STRING>)": ("STRING", "array_join(parts, sep)"),
    "text_repeat(s STRING, n INT)": ("STRING", "repeat(s, n)"),
    "text_replace(s STRING, old STRING, new STRING)": ("STRING", "replace(s, old, new)"),
    "text_translate(s STRING, a STRING, b STRING)": ("STRING", "translate(s, a, b)"),
    "text_reverse(s STRING)": ("STRING", "reverse(s)"),
    "text_ltrim(s STRING, chars STRING DEFAULT ' ')": ("STRING", "ltrim(chars, s)"),
    "text_rtrim(s STRING, chars STRING DEFAULT ' ')": ("STRING", "rtrim(chars, s)"),
    "text_trim(s STRING, chars STRING DEFAULT ' ')": ("STRING", "btrim(s, chars)"),
    "text_lpad(s STRING, n INT, pad STRING DEFAULT ' ')": ("STRING", "lpad(s, n, pad)"),
    "text_rpad(s STRING, n INT, pad STRING DEFAULT ' ')": ("STRING", "rpad(s, n, pad)"),
    # ids
    "uuid4()": ("STRING", "uuid()"),
    "uuid_str(b BINARY)": ("STRING", "CASE WHEN octet_length(b) = 16 THEN regexp_replace(lower(hex(b)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5') END"),
    "uuid_blob(s STRING)": ("BINARY", "CASE WHEN s RLIKE '^[{]?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}[}]?$' THEN unhex(regexp_replace(s, '[{}-]', '')) END"),
    "uuid7()": (
        "STRING",
        "regexp_replace(concat(lpad(lower(hex(unix_millis(current_timestamp()))), 12, '0'), '7', substring(replace(uuid(), '-', ''), 1, 3), substring(replace(uuid(), '-', ''), 17, 16)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')",
    ),
    # fuzzy
    "fuzzy_leven(a STRING, b STRING)": ("INT", "levenshtein(a, b)"),
    "fuzzy_hamming(a STRING, b STRING)": ("INT", "CASE WHEN length(a) <> length(b) THEN -1 WHEN length(a) = 0 THEN 0 ELSE aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> CAST(x <> y AS INT)), 0, (n, x) -> n + x) END"),
    "fuzzy_soundex(s STRING)": ("STRING", "soundex(s)"),
    # loose arithmetic and comparison
    "div_int(a BIGINT, b BIGINT)": ("BIGINT", "CASE WHEN b <> 0 THEN a div b END"),
    "mod_safe(a BIGINT, b BIGINT)": ("BIGINT", "try_mod(a, b)"),
    "like_nocase(s STRING, pattern STRING)": ("BOOLEAN", "s ILIKE pattern ESCAPE '\u0001'"),
    "max_of(a DOUBLE, b DOUBLE)": ("DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END"),
    "min_of(a DOUBLE, b DOUBLE)": ("DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END"),
    "to_int_loose(s STRING)": ("BIGINT", "coalesce(try_cast(regexp_extract(trim(s), '^([+-]?[0-9]+)', 1) AS BIGINT), CASE WHEN s IS NOT NULL THEN 0 END)"),
    "trunc_num(x DOUBLE)": ("BIGINT", "CAST(x AS BIGINT)"),
    "sqrt_safe(x DOUBLE)": ("DOUBLE", "CASE WHEN x >= 0 THEN sqrt(x) END"),
    "ln_safe(x DOUBLE)": ("DOUBLE", "CASE WHEN x > 0 THEN ln(x) END"),
    "zeroblob(n INT)": ("BINARY", "unhex(repeat('00', n))"),
    "quote_text(s STRING)": ("STRING", "coalesce(concat('''', replace(s, '''', ''''''), ''''), 'NULL')"),
    # dates
    "julianday(t TIMESTAMP)": ("DOUBLE", "unix_micros(t) / 86400000000D + 2440587.5D"),
    "unixepoch(t TIMESTAMP)": ("BIGINT", "unix_timestamp(t)"),
    "date_text(t TIMESTAMP)": ("STRING", "date_format(t, 'yyyy-MM-dd')"),
    "time_text(t TIMESTAMP)": ("STRING", "date_format(t, 'HH:mm:ss')"),
    "datetime_text(t TIMESTAMP)": ("STRING", "date_format(t, 'yyyy-MM-dd HH:mm:ss')"),
    "strftime(f STRING, t TIMESTAMP)": (
        "STRING",
        "date_format(t, replace(replace(replace(replace(replace(replace(replace(replace(f, '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'), '%j', 'DDD'), '%%', '%'))",
    ),
    "timediff(a TIMESTAMP, b TIMESTAMP)": ("STRING", "concat(CASE WHEN a < b THEN '-' ELSE '+' END, CAST(abs(unix_micros(a) - unix_micros(b)) div 1000000 AS STRING))"),
    # json
    "json_valid(s STRING)": ("INT", "CAST(try_parse_json(s) IS NOT NULL AS INT)"),
    "json_type(s STRING, path STRING DEFAULT '$')": ("STRING", "schema_of_variant(try_variant_get(try_parse_json(s), path, 'variant'))"),
    "json_quote(s STRING)": ("STRING", "CASE WHEN s IS NULL THEN 'null' ELSE substring(to_json(array(s)), 2, length(to_json(array(s))) - 2) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions of the packs; returns their names."""
    from rillstore.cluster import ship_package
    from rillstore.functions import fuzzy, json_edit

    ship_package(spark)
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    fuzzy.register(spark)
    json_edit.register(spark)
    return sorted([s.partition("(")[0] for s in FUNCTIONS])
