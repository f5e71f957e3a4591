"""URL encoding and resolution as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_trim, let

# ASCII signs that stay as they are in each part of a URL.
KEEP_COMPONENT = "!'()~*"
KEEP_PATH = "!$%&'()*+,/:;=@[]|~"
KEEP_QUERY = "!$%&()*+,/:;=?@[\\]^`{|}~"
KEEP_FRAGMENT = "!#$%&'()*+,/:;=?@[\\]^{|}~"

ABSOLUTE = r"(?i)^https?://"
# The usual cases: a link with nothing to escape or resolve, on a page with a plain address.
PLAIN = r"[A-Za-z0-9_~!$&()*+,;=@%\-]"
ROOT_LINK = rf"\A/(?![/.])(?:{PLAIN}++|[:?.]|/(?!\.))*+\z"
NEAR_LINK = rf"\A{PLAIN}++(?:{PLAIN}++|[?.]|/(?!\.))*+\z"
PLAIN_BASE = r"\A(https?://[a-z0-9.\-]+)(?:[/?#]|\z)"
BARE_HOST = r"\A(https?://[a-z0-9.\-]+)(?:[?#]|\z)"
PLAIN_FOLDER = rf"\A(https?://[a-z0-9.\-]+/(?:(?!\.)[A-Za-z0-9_~!$&()*+,;=:@%.\-]*/)*)(?!\.)[A-Za-z0-9_~!$&()*+,;=:@%.\-]*(?:[?#]|\z)"
BASE = r"(?i)^(https?):/*([^/\\?#]+)([^?#]*)(\?[^#]*)?"


def _escape(c: Column, keep: str) -> Column:
    """Percent-encode as UTF-8, then give back the signs in ``keep`` ('%' last, so old escapes survive)."""
    signs = [k for k in keep if k not in "%*"] + (["%"] if "%" in keep else [])
    encoded = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.aggregate(
        F.array(*[F.lit(k) for k in signs]),
        encoded,
        lambda acc, k: F.replace(acc, F.concat(F.lit("%"), F.hex(k)), k),
    )


def _escape_if_needed(c: Column, keep: str) -> Column:
    plain = "".join("\\" + k for k in keep)
    return F.when(c.rlike(rf"\A[A-Za-z0-9._\-{plain}]*\z"), c).otherwise(_escape(c, keep))


def encode_component(c: Column) -> Column:
    """Percent-encode one value for use inside a URL."""
    return _escape(c, KEEP_COMPONENT)


def _remove_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    dot, up = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"

    def fold(parts: Column) -> Column:
        kept = F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s.rlike(up), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s.rlike(dot), acc)
            .otherwise(F.array_append(acc, s)),
        )
        ends_in_dots = F.element_at(parts, -1).rlike(r"(?i)^(\.|%2e){1,2}$")
        segments = F.when(ends_in_dots, F.array_append(kept, F.lit(""))).otherwise(kept)
        return F.concat(F.lit("/"), F.array_join(segments, "/"))

    return F.when(path.rlike(r"(?i)/(\.|%2e)"), let(F.split(path, "/", -1), fold)).otherwise(path)


def _base_parts(base: Column) -> Column:
    scheme = F.lower(F.regexp_extract(base, BASE, 1))
    host = F.lower(F.regexp_extract(base, BASE, 2))
    path = F.regexp_extract(base, BASE, 3)
    return F.struct(
        scheme.alias("scheme"),
        # The scheme's own port is left out.
        F.regexp_replace(F.concat(scheme, F.lit("://"), host), r"^(http:.*):80$|^(https:.*):443$", "$1$2").alias("origin"),
        F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
        F.regexp_extract(base, BASE, 4).alias("query"),
    )


def _full_resolve(s: Column, base: Column) -> Column:
    """Any link on any page; every intermediate value is computed once."""
    link = F.struct(
        F.replace(F.regexp_extract(s, r"^[^?#]*", 0), F.lit("\\"), F.lit("/")).alias("path"),
        F.regexp_extract(s, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
        F.regexp_extract(s, r"(#[\s\S]*)$", 1).alias("frag"),
    )

    def target(r: Column, b: Column) -> Column:
        def make(origin, path, query):
            return F.struct(origin.alias("origin"), path.alias("path"), query.alias("query"), r["frag"].alias("frag"))

        other_host = F.concat(b["scheme"], F.lit("://"), F.lower(F.regexp_extract(r["path"], r"^//+([^/]*)", 1)))
        other_path = F.regexp_replace(r["path"], r"^//+[^/]*", "")
        return (
            F.when(r["path"].startswith("//"), make(other_host, other_path, r["query"]))
            .when(r["path"].startswith("/"), make(b["origin"], r["path"], r["query"]))
            .when(r["path"] != "", make(b["origin"], F.concat(F.regexp_extract(b["path"], r"^.*/", 0), r["path"]), r["query"]))
            .when(r["query"] != "", make(b["origin"], b["path"], r["query"]))
            .otherwise(make(b["origin"], b["path"], b["query"]))
        )

    def write(t: Column) -> Column:
        path = F.when(t["path"] == "", F.lit("/")).otherwise(t["path"])
        return F.concat(
            t["origin"],
            let(_remove_dots(path), lambda p: _escape_if_needed(p, KEEP_PATH)),
            _escape_if_needed(t["query"], KEEP_QUERY),
            _escape_if_needed(t["frag"], KEEP_FRAGMENT),
        )

    full = let(_base_parts(base), lambda b: let(link, lambda r: let(target(r, b), write)))
    return F.when(base.rlike(BASE), full).otherwise(s)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` as seen from ``base``.

    Blank stays '', an absolute http(s) address stays untouched, and what cannot be resolved is
    returned as it came.
    """

    def choose(s: Column) -> Column:
        origin = F.regexp_extract(base, PLAIN_BASE, 1)
        return (
            F.when((s == "") | s.rlike(ABSOLUTE), s)
            .when(s.rlike(ROOT_LINK) & base.rlike(PLAIN_BASE), F.concat(origin, s))
            .when(s.rlike(NEAR_LINK) & base.rlike(PLAIN_FOLDER), F.concat(F.regexp_extract(base, PLAIN_FOLDER, 1), s))
            .when(s.rlike(NEAR_LINK) & base.rlike(BARE_HOST), F.concat(origin, F.lit("/"), s))
            .when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), s)
            .otherwise(let(F.translate(s, "\t\n\r", ""), lambda x: _full_resolve(x, base)))
        )

    return let(js_trim(F.coalesce(href, F.lit(""))), choose)


def resolve_link(value: Column, base: Column) -> Column:
    """Like :func:`resolve_url`, but script, data and mail addresses stay untouched."""
    return let(value, lambda v: F.when(v.rlike(r"(?i)^(javascript|data|mailto):"), v).otherwise(resolve_url(v, base)))
