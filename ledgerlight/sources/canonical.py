"""S3: event canonicaliser.

Raw event files arrive as text: every CSV value is a string, ``properties``
is JSON or a Python dict repr, and field names drift (``feature`` vs
``feature_name``, ``session_duration`` vs ``duration_seconds``). This turns
such a frame into the canonical events schema with built-in expressions only.
The properties are read as a VARIANT, so nothing has to be known of their
keys; those outside the canonical schema can be kept as a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The numbers of ``properties`` that jobs use.
PROPERTY_NUMBERS = ("duration_seconds", "session_duration", "page_views", "actions")
# Python literals that a dict repr may contain, mapped to JSON.
_PY_LITERALS = (("None", "null"), ("True", "true"), ("False", "false"))
# pieces of a dict repr: a text in single or in double quotes, what lies between
# texts, or a quote that nothing closes
_PIECES = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|['"]"""


def parse_event_time(c: str | Column) -> Column:
    """Text to UTC wall-clock timestamp. ISO-8601 with ``T`` or space, with
    ``Z`` or a ``+hh:mm`` offset (converted to UTC) or naive (taken as UTC);
    anything else becomes NULL. Needs the session time zone to be UTC."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.try_to_timestamp(s).cast("timestamp_ntz")


def repr_to_json(c: str | Column) -> Column:
    """A Python dict repr as JSON text. Only what stands outside quotes is
    taken for a literal: a value 'None shall pass' stays as it is."""
    def piece(t: Column) -> Column:
        single, double = t.startswith("'") & (F.length(t) > 1), t.startswith('"')
        inside = F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit("\\'"), F.lit("'"))
        text = F.when(single, F.concat(F.lit('"'), F.regexp_replace(inside, r'(?<!\\)"', r'\\"'), F.lit('"'))).otherwise(t)
        # a byte escape has four digits in JSON; an escaped backslash before an x is none
        text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
        bare = t
        for py, js in _PY_LITERALS:
            bare = F.regexp_replace(bare, rf"\b{py}\b", js)
        return F.when(single | double, text).otherwise(bare)

    s = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_PIECES), F.lit(0)), piece), "")


def parse_variant(c: str | Column) -> Column:
    """JSON or Python-dict-repr text as a VARIANT; NULL where it is neither."""
    s = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_parse_json(s), F.try_parse_json(repr_to_json(s)))


def parse_properties(c: str | Column) -> Column:
    """JSON or Python-dict-repr text to the struct of PROPERTY_NUMBERS."""
    v = parse_variant(c)
    return F.struct(*[F.try_variant_get(v, f"$.{n}", "double").alias(n) for n in PROPERTY_NUMBERS])


def unknown_properties(c: str | Column, known: tuple[str, ...] = PROPERTY_NUMBERS) -> Column:
    """The keys of a properties text that the canonical schema lacks, as a map
    from key to text (nested values as JSON); NULL where the text is no object."""
    every = F.from_json(F.to_json(parse_variant(c)), "map<string,string>")
    return F.map_filter(every, lambda k, v: ~k.isin(*known))


def _first_present(df: DataFrame, *names: str) -> Column:
    cols = [F.col(n) for n in names if n in df.columns]
    if not cols:
        return F.lit(None).cast("string")
    return cols[0] if len(cols) == 1 else F.coalesce(*cols)


def canonical_events(df: DataFrame, parse_time: bool = True, keep_unknown: bool = False) -> DataFrame:
    """Cast and rename raw event columns to the canonical schema.

    ``parse_time=False`` leaves ``timestamp`` as text so that the cleaning
    step can parse and count it (CL3). ``keep_unknown`` adds the properties the
    schema lacks as a map ``extra`` (where ``properties`` is text).
    """
    kind = dict(df.dtypes).get("properties")
    props = parse_properties("properties") if kind == "string" else F.col("properties")
    known = set(PROPERTY_NUMBERS) if kind == "string" else \
        set(df.schema["properties"].dataType.names) if kind and kind.startswith("struct") else set()

    def number(*names: str) -> Column:
        found = [props[n].cast("double") for n in names if n in known]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    fields = [number("duration_seconds", "session_duration").alias("duration_seconds")]
    fields += [number(n).alias(n) for n in ("page_views", "actions") if n in known]
    ts = _first_present(df, "timestamp")
    return df.select(
        (F.col("event_id").cast("bigint") if "event_id" in df.columns else _row_key(df)).alias("event_id"),
        _first_present(df, "customer_id").cast("string").try_cast("bigint").alias("customer_id"),
        _first_present(df, "user_id").cast("string").alias("user_id"),
        _first_present(df, "event_type").cast("string").alias("event_type"),
        _first_present(df, "feature_name", "feature").cast("string").alias("feature_name"),
        _first_present(df, "subscription_tier").cast("string").alias("subscription_tier"),
        (parse_event_time(ts) if parse_time else ts.cast("string")).alias("timestamp"),
        F.struct(*fields).alias("properties"),
        *([unknown_properties("properties").alias("extra")] if keep_unknown and kind == "string" else []),
    )


def _row_key(df: DataFrame) -> Column:
    """An order key for rows that come without an id: a hash of all their
    columns, the same wherever and whenever the row is read."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "<" in kind else F.col(c).cast("string") for c, kind in df.dtypes])


def canonical_sessions(df: DataFrame) -> DataFrame:
    """Raw session columns (text) cast to the canonical schema; what does not
    read as a number or time becomes NULL."""
    names = ("session_id", "customer_id", "user_id", "start_time", "end_time", "duration")
    text = {n: _first_present(df, n).cast("string") for n in names}
    return df.select(
        text["session_id"].alias("session_id"), text["customer_id"].try_cast("bigint").alias("customer_id"),
        text["user_id"].alias("user_id"), parse_event_time(text["start_time"]).alias("start_time"),
        parse_event_time(text["end_time"]).alias("end_time"),
        text["duration"].try_cast("double").try_cast("bigint").alias("duration"))
