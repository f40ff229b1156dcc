"""Text, number, name and JSON helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmill.registry import POSTING_NAMES

#: Fixed words and suffixes, in their natural order.
TRUE_WORDS, FALSE_WORDS = ["1", "true", "yes", "y", "on"], ["0", "false", "no", "n", "off"]
LINK_SUFFIXES = [".zip", ".csv", ".gz", ".tgz", ".tar", ".xlsx", ".xls"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_c(c).cast("string")), F.lit(""))


def number(c: Column | str, default: float | None = None) -> Column:
    """The number a text holds; missing words, NaN and junk are null (or the default)."""
    x = F.trim(_c(c).cast("string")).try_cast("double")
    x = F.when(~F.isnan(x), x)
    return x if default is None else F.coalesce(x, F.lit(default))


def whole_number(c: Column | str, default: int | None = None) -> Column:
    x = F.trim(_c(c).cast("string")).try_cast("bigint")
    return x if default is None else F.coalesce(x, F.lit(default))


def boolean(c: Column | str) -> Column:
    t = F.lower(F.trim(_c(c).cast("string")))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def net_load(load: str, wind: str, solar: str) -> Column:
    """Null as soon as one of the three is missing."""
    return F.col(load) - F.col(wind) - F.col(solar)


def interval_revenue(price: Column | str, mw: Column | str) -> Column:
    """Of a quarter of an hour."""
    return _c(price) * _c(mw) * 0.25


def row_sum(*columns: str) -> Column:
    """Across columns, nulls skipped; nothing but nulls is 0."""
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out


def _scaled(size: Column, units: list[str], largest: str | None, decimals: int, whole_bytes: bool, gap: str) -> Column:
    units, out = units[: units.index(largest) + 1 if largest else None], None
    for power, unit in enumerate(units):
        if whole_bytes and power == 0:
            text = F.format_string("%d", size.cast("long"))
        else:
            # A value half way between two is rounded to the even one, as C, Python and SQL engines do; Java's format rounds it up. Beyond a decimal's range none is half way.
            x = size / float(1024**power)
            text = F.coalesce(F.bround(x.try_cast("decimal(38,18)"), decimals).cast(f"decimal(38,{decimals})").cast("string"), F.format_string(f"%.{decimals}f", x))
        text, small = F.concat(text, F.lit(gap + unit)), size < float(1024 ** (power + 1))
        last = power == len(units) - 1
        out = (text if last else F.when(small, text)) if out is None else (out.otherwise(text) if last else out.when(small, text))
    return out


def human_bytes(c: Column | str, largest: str | None = None) -> Column:
    """1536 is '1.50 KB'. Sizes beyond the largest unit ('TB', or the one named) are given in it."""
    return _scaled(_c(c).cast("double"), ["B", "KB", "MB", "GB", "TB"], largest, 2, False, " ")


def short_bytes(c: Column | str, largest: str | None = None) -> Column:
    """1536 is '1.5K', 12 is '12B'. Sizes beyond the largest unit ('T', or the one named) are given in it."""
    return _scaled(_c(c).cast("double"), ["B", "K", "M", "G", "T"], largest, 1, True, "")


def safe_name(c: Column | str) -> Column:
    """Letters, digits, dot, dash and underscore; every other run is one underscore."""
    return F.regexp_replace(F.trim(_c(c)), r"[^A-Za-z0-9._-]+", "_")


def with_doc_id(name: Column | str, doc_id: Column | str) -> Column:
    """name__id.ext"""
    n = _c(name)
    return F.concat(F.regexp_replace(n, r"(\.[^.]*)$", ""), F.lit("__"), _c(doc_id).cast("string"), F.regexp_extract(n, r"(\.[^.]*)$", 1))


def doc_id_of(path: Column | str) -> Column:
    """The id in name__id or name__id.ext; null without one, or for a sidecar."""
    p = _c(path)
    return F.when(~p.rlike(r"\.(docids|meta|sortcache)(\.json)?$"), F.nullif(F.regexp_extract(p, r"__([^/_.]+)(\.[A-Za-z0-9]+)?$", 1), F.lit("")))


def file_name_of_url(url: Column | str) -> Column:
    path = F.regexp_replace(F.regexp_replace(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.nullif(F.regexp_extract(path, r"([^/]*)/?$", 1), F.lit(""))


def query_keys(url: Column | str) -> Column:
    """Names in a url's query, sorted, each once."""
    q = F.regexp_extract(_c(url), r"\?([^#]*)", 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(q, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")))


def fingerprint(columns: list[str]) -> Column:
    """All values trimmed, missing ones as blanks: compared whole, never only by a hash."""
    return F.struct(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(f"f{i}") for i, c in enumerate(columns)])


def event_line(event: Column | str, fields: Column | str) -> Column:
    """EVENT k=v k=v with values quoted as JSON unless they are plain; fields: map<string,string>."""
    quoted = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    value = lambda v: F.when(v.isNull(), "null").when(v.rlike(r"^[A-Za-z0-9._:/+-]+$"), v).otherwise(quoted(v))
    return F.concat_ws(" ", _c(event), F.array_join(F.transform(F.map_entries(_c(fields)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), " "))


#: A k=v part of a log line: the whole, its key, its value as it is written.
_FIELD = r'(?:^|\s)(([A-Za-z_]\w*)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|\S*))'


def event_parts(line: Column | str) -> Column:
    """The k=v parts of a log line as they are written, in order."""
    return F.regexp_extract_all(_c(line), F.lit(_FIELD), F.lit(1))


def event_value(parts: Column | str, key: str) -> Column:
    """A key's value in a line's event_parts: quoted ones are read as JSON text, the last counts; null without one."""
    own = F.filter(_c(parts), lambda p: p.startswith(f"{key}="))
    v = F.substring(F.get(own, F.size(own) - 1), len(key) + 2, 1 << 30)
    return F.when(v.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"), v)).otherwise(v)


def event_fields(line: Column | str) -> Column:
    """map of the k=v parts of a log line; quoted values are read as JSON text, and of a repeated key the last value counts."""
    names = F.regexp_extract_all(_c(line), F.lit(_FIELD), F.lit(2))
    values = F.regexp_extract_all(_c(line), F.lit(_FIELD), F.lit(3))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    read = lambda v: F.when(v.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"), v)).otherwise(v)
    once = F.array_distinct(names)
    return F.map_from_arrays(once, F.transform(once, lambda k: read(F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


def csv_cells(line: Column | str) -> Column:
    """The cells of one CSV line: quoted ones may hold commas and doubled quotes; other cells are trimmed. A line without quotes is just split."""
    raw = F.regexp_extract_all(F.concat(_c(line), F.lit(",")), F.lit(r'(\s*"[^"]*+(?:""[^"]*+)*+"\s*|[^,]*+),'), F.lit(1))
    bare = lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))
    quoted = F.transform(F.transform(raw, lambda x: F.trim(x)), lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.char_length(x) > 1), bare(x)).otherwise(x))
    return F.when(_c(line).contains('"'), quoted).otherwise(F.transform(F.split(_c(line), ","), lambda x: F.trim(x)))


def csv_cell(line: Column | str, place: Column) -> Column:
    """One of csv_cells, by its place from 0 (null beyond the last): of a line without quotes only that cell is looked for and trimmed."""
    bare = F.when(place == 0, F.substring_index(_c(line), ",", 1)).otherwise(F.get(F.split(_c(line), ","), place))
    return F.when(_c(line).contains('"'), F.get(csv_cells(line), place)).otherwise(F.trim(bare))


def csv_records(body: Column | str) -> Column:
    """The CSV records of a whole text, blank ones left out; a line break inside quotes belongs to its cell. A quote that is never closed ends with the text."""
    cell = r'(?:[ \t]*+"[^"]*+(?:""[^"]*+)*+"?)?+[^,\r\n]*+'
    found = F.regexp_extract_all(_c(body), F.lit(f"({cell}(?:,{cell})*+)"), F.lit(1))
    plain = F.split(_c(body), r"\r\n|[\r\n]")
    return F.filter(F.when(_c(body).contains('"'), found).otherwise(plain), lambda x: F.trim(x) != "")


def json_doc_id(json: Column | str) -> Column:
    """docId, else docLookupId, else doclookupId."""
    return F.coalesce(*[blank_to_null(F.get_json_object(_c(json), f"$.{k}")) for k in ("docId", "docLookupId", "doclookupId")])


def json_link(json: Column | str, rel: str) -> Column:
    return blank_to_null(F.get_json_object(_c(json), f"$._links.{rel}.href"))


def name_failure(error: Column | str) -> Column:
    """Whether an error's text is that of a host name that could not be resolved."""
    # What resolvers say.
    markers = ["name resolution", "nodename nor servname", "name or service not known", "getaddrinfo failed", "failed to resolve"]
    low = F.lower(_c(error))
    return F.coalesce(F.greatest(*[low.contains(m) for m in markers]), F.lit(False))


def retry_after(header: Column | str, now: Column) -> Column:
    """Seconds to wait from a Retry-After header: a number, or a date later than now; null for anything else."""
    t = F.trim(_c(header))
    at = F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros(now.cast("timestamp"))) / 1e6))
    number_ = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
    return F.coalesce(number_, wait)


def file_link(href: Column | str) -> Column:
    """Whether a link ends like a data file, whatever its query."""
    path = F.lower(F.regexp_replace(_c(href), r"[?#].*$", ""))
    return F.greatest(*[F.endswith(path, F.lit(s)) for s in LINK_SUFFIXES])


def snake_case(name: str) -> str:
    s = re.sub(r"[^0-9A-Za-z]+", "_", name.strip())
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", s)
    return s.strip("_").lower()


def header_order_column(columns: list[str], names: list[str] = POSTING_NAMES) -> str | None:
    """The first column of the header, as it stands, under any of the names in any case; posting_column goes by the names' order instead."""
    low = {n.lower() for n in names}
    return next((c for c in columns if c.strip().lower() in low), None)


def posting_column(columns: list[str]) -> str | None:
    """The posting-time column under any of its names, the preferred name first."""
    have = {c.strip().lower(): c for c in reversed(columns)}
    exact = [c for n in POSTING_NAMES for c in columns if c.strip() == n]
    return exact[0] if exact else next((have[n.lower()] for n in POSTING_NAMES if n.lower() in have), None)


def choose_column(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate there is, spelled exactly; else the first in any case."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((c for c in candidates if c in columns), None) or next((low[c.lower()] for c in candidates if c.lower() in low), None)


def clean_header(columns: list[str]) -> list[str]:
    """Trimmed, without blanks and posting names, each once, in order."""
    names = {n.lower() for n in POSTING_NAMES}
    return list(dict.fromkeys(t for c in columns if (t := c.strip()) and t.lower() not in names))


def first_value(columns: list[str], candidates: list[str]) -> Column:
    """Per row, the first of the candidate columns (in any case) whose value isn't blank; null if there is none."""
    have = {c.strip().lower(): c for c in reversed(columns)}
    found = [blank_to_null(F.col(f"`{have[n.lower()]}`")) for n in candidates if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")
