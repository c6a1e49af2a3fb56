"""Column functions of the history model: ids, names, paths, modes, times and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_OID = "0" * 40


def object_id(kind: str | Column, data: Column) -> Column:
    """The content address: SHA-1 over the type, the size, a NUL byte and the bytes."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    data = data.cast("binary")
    header = F.encode(F.concat(kind, F.lit(" "), F.octet_length(data).cast("string")), "UTF-8")
    return F.sha1(F.concat(header, F.to_binary(F.lit("00"), F.lit("hex")), data))


def is_oid(oid: Column) -> Column:
    return F.coalesce(oid.rlike("^[0-9a-f]{40}$"), F.lit(False))


#: White space and other characters that a reference name may not have.
_NOT_IN_REFS = r"[\x00-\x20\x7f\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff~^:?*\[\\<>\"'&`]"
#: First segments that aren't repositories.
RESERVED = ("api", "cgit.css", "favicon.ico", "robots.txt", "info", "git-upload-pack", "git-receive-pack")


def is_ref_name(name: Column) -> Column:
    """Whether a pushed reference may have this name; its length is counted in UTF-16 units."""
    units = F.length(name) + F.regexp_count(name, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    bad = (
        name.rlike(_NOT_IN_REFS)
        | name.contains("..")
        | name.contains("@{")
        | name.contains("//")
        | name.endswith("/")
        | name.endswith(".lock")
        | name.rlike(r"(^|/)\.")
        | (units > 255)
    )
    return F.coalesce(name.startswith("refs/") & ~bad, F.lit(False))


def is_repo_name(name: Column, namespaced: bool = False) -> Column:
    """One segment, or two where names have namespaces; no reserved word in front."""
    part = r"[A-Za-z0-9][A-Za-z0-9._-]*"
    shape = f"^{part}/{part}\\z" if namespaced else f"^{part}\\z"
    return F.coalesce(name.rlike(shape) & ~F.substring_index(name, "/", 1).isin(*RESERVED), F.lit(False))


def in_namespace(name: Column, namespace: str) -> Column:
    """A prefix test, which reaches the Parquet scan as a pushed filter."""
    return name.startswith(f"{namespace}/")


def short_ref(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/(heads|tags)/", "")


def period_key(seconds: Column, period: str) -> Column:
    """Bucket of a commit time (unix seconds, UTC): y, q, w, or m for anything else.

    A week is a seventh of the year counted from its first instant, so that it depends on the time of day; it is neither
    the ISO week nor a count of whole days.
    """
    at = F.timestamp_seconds(seconds)
    if period == "y":
        return F.date_format(at, "yyyy")
    if period == "q":
        return F.concat(F.date_format(at, "yyyy"), F.lit("-Q"), F.quarter(at).cast("string"))
    if period == "w":
        first = F.unix_timestamp(F.date_trunc("year", at))
        week = F.ceil(((seconds - first) / F.lit(86400.0) + 1) / 7)
        return F.concat(F.date_format(at, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(at, "yyyy-MM")


def age(seconds: Column, now: int | Column) -> Column:
    """How long ago, in the largest fitting unit, in the singular for one; empty for the time 0."""
    now = F.lit(now) if isinstance(now, int) else now
    d = F.greatest(F.lit(0), now - seconds)
    hour, day = 3600, 86400

    def unit(size: int, name: str) -> Column:
        n = F.floor(d / size)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))

    return (
        F.when(seconds == 0, "")
        .when(d < hour, F.concat(F.greatest(F.lit(1), F.floor(d / 60)).cast("string"), F.lit(" min.")))
        .when(d < day, unit(hour, "hour"))
        .when(d < 7 * day, unit(day, "day"))
        .when(d < 31 * day, unit(7 * day, "week"))
        .when(d < 365 * day, unit(30 * day, "month"))
        .otherwise(unit(365 * day, "year"))
    )


def zone_seconds(zone: Column) -> Column:
    """Seconds east of UTC of a zone such as +0530; 0 where it isn't one."""
    size = F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60
    return F.when(zone.rlike("^[+-][0-9]{4}$"), F.when(zone.startswith("-"), -size).otherwise(size)).otherwise(0)


def format_date(seconds: Column, zone: Column) -> Column:
    """The clock in UTC, with the zone appended as it is."""
    return F.concat_ws(" ", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), zone)


def format_rfc2822(seconds: Column, zone: Column) -> Column:
    """The clock shifted into the zone."""
    return F.concat_ws(" ", F.date_format(F.timestamp_seconds(seconds + zone_seconds(zone)), "EEE, d MMM yyyy HH:mm:ss"), zone)


def format_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _mode_bits(mode: Column) -> Column:
    return F.conv(mode, 8, 10).cast("int")


def mode_kind(mode: Column) -> Column:
    """tree, commit (a link to another repository), symlink, or blob."""
    bits = _mode_bits(mode)
    return (
        F.when(mode.isin("40000", "040000"), "tree")
        .when(mode == "160000", "commit")
        .when(bits.bitwiseAND(F.lit(0o170000)) == 0o120000, "symlink")
        .otherwise("blob")
    )


def mode_string(mode: Column) -> Column:
    """As a listing shows it: a file's bits as rwx for user, group and others; other kinds have fixed forms."""
    bits, kind = _mode_bits(mode), mode_kind(mode)
    flags = [F.when(bits.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.when(kind == "tree", "d---------").when(kind == "commit", "m---------").when(kind == "symlink", "lrwxrwxrwx").otherwise(F.concat(F.lit("-"), *flags))


def path_segments(path: Column) -> Column:
    """The segments of a request path: decoded, without empty ones and the dots."""
    parts = F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    return F.filter(parts, lambda s: ~s.isin("", ".", ".."))


def is_safe_path(path: Column) -> Column:
    """Whether an archive may hold an entry of this path."""
    return ~path.contains("\\") & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def is_safe_target(target: Column) -> Column:
    """Whether a symbolic link in an archive may point there."""
    return ~target.startswith("/") & ~F.exists(F.split(target, "/"), lambda s: s == "..")


def is_binary(data: Column) -> Column:
    """A NUL byte among the first 8000 bytes; works on text columns too."""
    head = F.substring(data.cast("binary"), 1, 8000)
    return F.contains(head, F.to_binary(F.lit("00"), F.lit("hex")))


def text_lines(text: Column) -> Column:
    """Lines of a text; a last empty one, after a final newline, isn't counted."""
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def mentions(field: Column, query: str) -> Column:
    """Whether the field contains the query, case aside, as a plain string."""
    return F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(query.lower()))


#: Content types by file extension; what a browser would run is served as text.
CONTENT_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "text/plain; charset=utf-8",
    "pdf": "application/pdf", "html": "text/plain",
}


def content_type(path: Column, data: Column) -> Column:
    """By the extension, which is the whole name where it has no point, else by the bytes."""
    extension = F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1))
    known = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))[extension]
    return F.coalesce(known, F.when(is_binary(data), "application/octet-stream").otherwise("text/plain; charset=utf-8"))


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text
