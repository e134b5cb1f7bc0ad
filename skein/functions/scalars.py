"""Scalar functions over columns; all of them run inside the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

URL = "^https?://"
ISO = "yyyy-MM-dd HH:mm:ss"


def square_root(x: Column) -> Column:
    """NaN for a negative number."""
    return F.sqrt(x)


def square(x: Column) -> Column:
    return x * x


def roots_of_list(text: Column, sep: str = "[|]") -> Column:
    """Square roots of the numbers in a text; what is no number gives null."""
    return F.transform(F.split(text, sep), lambda s: F.sqrt(F.trim(s).try_cast("double")))


def truncate(text: Column, chars: int = 500, lines: int = 4) -> Column:
    """The first ``chars`` characters and dots, or the first ``lines`` lines and dots, or the text if it is short."""
    parts = F.split(text, "\n")
    return (
        F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("...")))
        .when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n...")))
        .otherwise(text)
    )


def truncate_value(text: Column, chars: int = 100) -> Column:
    """A long value is cut, unless it is a web address."""
    return F.when((F.length(text) > chars) & ~text.rlike(URL), F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)


def truncate_list(items: Column, most: int = 2) -> Column:
    """The first values of a list, each cut as ``truncate_value`` does."""
    return F.transform(F.slice(items, 1, most), lambda x: truncate_value(x))


def indented_json(entries: Column) -> Column:
    """A map of texts as JSON with an entry a line, indented by two spaces; an empty map in one line."""
    quoted = lambda x: F.coalesce(F.to_json(F.struct(x.alias("x"))), F.lit("null"))
    inner = lambda x: F.when(x.isNull(), F.lit("null")).otherwise(F.regexp_extract(quoted(x), '^\\{"x":(.*)\\}$', 1))
    lines = F.transform(F.map_entries(entries), lambda e: F.concat(F.lit("  "), inner(e["key"]), F.lit(": "), inner(e["value"])))
    return F.when(F.size(entries) == 0, F.lit("{}")).otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def truncate_object(entries: Column, chars: int = 100) -> Column:
    """A map of texts as JSON, or how long it is if it is long."""
    text = indented_json(entries)
    return F.when(F.length(text) > chars, F.concat(F.lit("Truncated "), F.length(text).cast("string"), F.lit(" characters..."))).otherwise(text)


def json_or_text(text: Column, path: str) -> Column:
    """A field of a JSON text, or the text itself where it is no JSON."""
    return F.when(F.try_parse_json(text).isNull(), text).otherwise(F.get_json_object(text, path))


def json_entries(text: Column) -> Column:
    """Entries (key, value) of a JSON object; none where it is no object."""
    return F.map_entries(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")))


def prettify(label: Column) -> Column:
    """snake_case and camelCase as words that begin with capitals."""
    return F.initcap(F.regexp_replace(F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1 $2"), "_+", " "))


def pretty_date(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy hh:mm a")


def pretty_date_text(text: Column) -> Column:
    """As ``pretty_date`` for a text; null where it is no time."""
    return pretty_date(F.try_to_timestamp(text))


def without_final_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def with_parameter(url: Column, name: str, value: Column) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}="), F.url_encode(value))


def base64_text(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data.cast("binary")), "[\r\n]", "")


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64_text(data))


def content_block(mime: Column, data: Column) -> Column:
    kind = F.when(mime.startswith("image/"), "image").when(mime.startswith("audio/"), "audio").otherwise("file")
    return F.struct(kind.alias("type"), mime.alias("mime_type"), base64_text(data).alias("base64"))


def day_half(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "morning").otherwise("later")


def short_id(text: Column) -> Column:
    return F.concat(F.left(text, F.lit(3)), F.lit("..."), F.right(text, F.lit(3)))


def without_final_newline(text: Column) -> Column:
    return F.regexp_replace(text, "\n\\z", "")


def fence_language(css_class: Column) -> Column:
    return F.nullif(F.regexp_extract(css_class, "language-(\\w+)", 1), F.lit(""))


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def remove_at(items: Column, place: int) -> Column:
    """The list without the element at a place, counted from 0."""
    return F.filter(items, lambda x, i: i != place)


def structured(text: Column, schema: str, required: list[str]) -> Column:
    """A JSON text as a struct; null where it doesn't parse or lacks a required field."""
    s = F.from_json(text, schema)
    full = F.lit(True)
    for name in required:
        full = full & s[name].isNotNull()
    return F.when(full, s)


def partial_json(text: Column) -> Column:
    """Arguments of a call that is still being written: the map so far, cut-off texts included; an empty one where nothing parses."""
    return F.coalesce(F.from_json(_repaired(text), "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def repair_json(text: str | None) -> str | None:
    """JSON that was cut off, closed where it ends, or else where its last whole value ends; None if that gives no JSON."""
    if text is None:
        return None
    closers: list[str] = []
    ends: list[tuple[int, str]] = []  # places at which it can be cut, and what closes it there
    in_string = escaped = False
    for k, c in enumerate(text):
        if in_string:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                in_string = False
        elif c == '"':
            in_string = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
            ends.append((k + 1, "".join(reversed(closers))))
        elif c in "}]" and closers:
            closers.pop()
            ends.append((k + 1, "".join(reversed(closers))))
        elif c == ",":
            ends.append((k, "".join(reversed(closers))))
    close = "".join(reversed(closers))
    whole = text[:-1] if escaped else text
    for tried in (whole + ('"' if in_string else "") + close, *(text[:k] + c for k, c in reversed(ends[-3:]))):
        try:
            json.loads(tried)
            return tried
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair_json, na_action="ignore")
