"""SQL fragments shared by the check queries."""

from __future__ import annotations

from ..functions.text import WS_CHARS
from ..functions.urls import KEEP_COMPONENT, KEEP_PATH


def trim(x: str) -> str:
    return f"trim({x}, '{WS_CHARS}')"


def unescape(x: str) -> str:
    for name, ch in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{ch}', 'g')"
    return x


def no_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def plain(x: str) -> str:
    """Text of an HTML fragment, trimmed."""
    return trim(unescape(no_tags(x)))


def clean_lines(x: str) -> str:
    t = trim("x")
    return (
        f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda x: {t}), lambda y: y <> ''), chr(10))"
    )


def html_to_text(x: str) -> str:
    """Readable text of a page or fragment of the shapes found in the pages table."""
    bare = f"regexp_replace({x}, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<style>.*?</style>|<script>.*?</script>', '', 'g')"
    breaks = f"regexp_replace({bare}, '<p>|<br>|</(p|li|div|h1|article)>', chr(10), 'g')"
    return clean_lines(f"replace({unescape(no_tags(breaks))}, chr(160), ' ')")


ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


def encode(x: str, keep: str) -> str:
    out = f"replace(url_encode({x}), '+', '%20')"
    for ch in [k for k in keep if k not in "%*"] + (["%"] if "%" in keep else []):
        lit = "''" if ch == "'" else ch
        out = f"replace({out}, '%{ord(ch):02X}', '{lit}')"
    return f"replace({out}, '%2A', '*')"


def encode_component(x: str) -> str:
    return encode(x, KEEP_COMPONENT)


def encode_path(x: str) -> str:
    return encode(x, KEEP_PATH)


def root_link(href: str, base: str) -> str:
    """Absolute form of a root-relative link."""
    return f"concat(regexp_extract({base}, '^https?://[^/?#]+'), {encode_path(href)})"


def norm_key(name: str, author: str) -> str:
    bare = f"regexp_replace(regexp_replace({name}, '\\s+', '', 'g'), '[（(][^)）]*[)）]', '', 'g')"
    return f"concat(lower({bare}), '|', lower({trim(f"coalesce({author}, '')")}))"
