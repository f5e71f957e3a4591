"""From landed bytes to checked text."""

from __future__ import annotations

import codecs
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import js_trim, normalize_newlines

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
HEAD_END = r"(?i)</head\b|<body\b"
META_CHARSET = r"(?i)<meta[^>]+charset=[\"']?\s*([\w-]+)"
DECLARED_CHARSET = r"(?i)encoding=[\"']([\w-]+)[\"']"
HEADER_CHARSET = r"(?i)charset=([\w-]+)"
GB_LABELS = ["gb2312", "gbk", "gb18030"]
# The labels that browsers know, by the codec that reads them.
LABELS = {
    "utf-8": r"utf-8|unicode-1-1-utf-8|unicode11utf8|unicode20utf8|x-unicode20utf8",
    "utf-16le": r"utf-16(le)?|csunicode|iso-10646-ucs-2|ucs-2|unicode|unicodefeff",
    "utf-16be": r"utf-16be|unicodefffe",
    "gb18030": r"gb18030|gbk|x-gbk|chinese|csgb2312|csiso58gb231280|gb_?2312|gb_2312-80|iso-ir-58",
    "big5hkscs": r"big5|big5-hkscs|cn-big5|csbig5|x-x-big5",
    "cp932": r"shift[_-]jis|sjis|x-sjis|csshiftjis|ms932|ms_kanji|windows-31j",
    "euc_jp": r"euc-jp|x-euc-jp|cseucpkdfmtjapanese",
    "iso2022_jp": r"iso-2022-jp|csiso2022jp",
    "cp949": r"euc-kr|cseuckr|csksc56011987|iso-ir-149|korean|ks_c_5601-198[79]|ksc_?5601|windows-949",
    "cp866": r"866|cp866|(cs)?ibm866",
    "koi8_r": r"koi|koi8|koi8[-_]r|cskoi8r",
    "koi8_u": r"koi8-r?u",
    "mac_roman": r"mac|(cs)?macintosh|x-mac-roman",
    "mac_cyrillic": r"x-mac-(cyrillic|ukrainian)",
    "cp874": r"windows-874|dos-874|tis-620|iso-?8859-?11",
    "cp1250": r"(windows-|x-cp|cp)1250",
    "cp1251": r"(windows-|x-cp|cp)1251",
    "cp1252": r"(windows-|x-cp|cp)1252|ansi_x3\.4-1968|(us-)?ascii|(cp|ibm)819|csisolatin1|iso-ir-100|l1|latin1"
    r"|iso[-_]8859-1|iso8859-?1|iso_8859-1:1987",
    "cp1253": r"(windows-|x-cp|cp)1253",
    "cp1254": r"(windows-|x-cp|cp)1254|csisolatin5|iso-ir-148|l5|latin5|iso[-_]8859-9|iso8859-?9|iso_8859-9:1989",
    "cp1255": r"(windows-|x-cp|cp)1255",
    "cp1256": r"(windows-|x-cp|cp)1256",
    "cp1257": r"(windows-|x-cp|cp)1257",
    "cp1258": r"(windows-|x-cp|cp)1258",
    "iso8859_2": r"iso[-_]8859-2|iso8859-?2|iso_8859-2:1987|csisolatin2|iso-ir-101|l2|latin2",
    "iso8859_3": r"iso[-_]8859-3|iso8859-?3|iso_8859-3:1988|csisolatin3|iso-ir-109|l3|latin3",
    "iso8859_4": r"iso[-_]8859-4|iso8859-?4|iso_8859-4:1988|csisolatin4|iso-ir-110|l4|latin4",
    "iso8859_5": r"iso[-_]8859-5|iso8859-?5|iso_8859-5:1988|csisolatincyrillic|cyrillic|iso-ir-144",
    "iso8859_6": r"iso[-_]8859-6|iso8859-?6|iso-8859-6-[ei]|iso_8859-6:1987|csiso88596[ei]|csisolatinarabic|arabic"
    r"|asmo-708|ecma-114|iso-ir-127",
    "iso8859_7": r"iso[-_]8859-7|iso8859-?7|iso_8859-7:1987|csisolatingreek|ecma-118|elot_928|greek8?|iso-ir-126|sun_eu_greek",
    "iso8859_8": r"iso[-_]8859-8|iso8859-?8|iso-8859-8-[ei]|iso_8859-8:1988|csiso88598[ei]|csisolatinhebrew|hebrew"
    r"|iso-ir-138|visual|logical",
    "iso8859_10": r"iso-8859-10|iso8859-?10|csisolatin6|iso-ir-157|l6|latin6",
    "iso8859_13": r"iso-8859-13|iso8859-?13",
    "iso8859_14": r"iso-8859-14|iso8859-?14",
    "iso8859_15": r"iso[-_]8859-15|iso8859-?15|csisolatin9|l9",
    "iso8859_16": r"iso-8859-16",
}


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Files as rows: path, length, content. Bytes are only read for rows that pass the length filter."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def size_reason(length: Column, most: int | None = None) -> Column:
    """Why a file is refused by its size; NULL when it is fine. There is a largest size only if one is given."""
    empty = F.when(length == 0, "empty")
    return empty if most is None else empty.when(length > most, "too_large")


def accept_size(files: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused); both filters are on the ``length`` column alone."""
    reason = size_reason(F.col("length"), most)
    refused = files.where(reason.isNotNull()).withColumn("reason", reason)
    return files.where(reason.isNull()), refused.drop("content")


def detect_encoding(content: Column, requested: str | None = None) -> Column:
    """Byte order mark first, then valid UTF-8, else GB18030; an explicit choice wins."""
    if requested:
        return F.lit(requested)
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", "utf-8")
        .when(head.startswith("FFFE"), "utf-16le")
        .when(head.startswith("FEFF"), "utf-16be")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .otherwise("gb18030")
    )


def codec_of(label: str) -> str:
    """The decoder of an encoding: Python's own name where it knows one, else by the labels of browsers."""
    try:
        return codecs.lookup(label).name
    except LookupError:
        return next((codec for codec, known in LABELS.items() if re.fullmatch(known, label)), label)


def _decode_other(content: Column, encoding: Column) -> Column:
    """Strict decoding in Arrow batches; NULL for malformed bytes (a native decode would fail the job)."""

    def run(raw: pd.Series, enc: pd.Series) -> pd.Series:
        def one(b, e):
            if b is None:
                return None
            mark = {"utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}.get(e, b"")
            try:
                return bytes(b).removeprefix(mark).decode(codec_of(e))
            except (UnicodeDecodeError, LookupError):
                return None

        return pd.Series([one(b, e) for b, e in zip(raw, enc)])

    return F.pandas_udf(run, "string")(content, encoding)


def decode_texts(
    files: DataFrame, content: str = "content", requested: str | None = None, most: int | None = None
) -> DataFrame:
    """Add ``encoding``, ``text`` and ``reason`` (NULL when the text is usable).

    Valid UTF-8 is decoded natively; only the other rows carry bytes into the Arrow step. Bytes refused
    for their size are not decoded.
    """
    refused = size_reason(F.length(content), most)
    enc = detect_encoding(F.col(content), requested)
    out = files.withColumn("encoding", enc)
    is_utf8 = F.col("encoding") == "utf-8"
    native = F.when(is_utf8 & refused.isNull() & F.is_valid_utf8(F.col(content).cast("string")), F.col(content).cast("string"))
    out = out.withColumn("_other", F.when(~is_utf8 & refused.isNull(), F.col(content)))
    other = _decode_other(F.col("_other"), F.col("encoding"))
    out = out.withColumn("text", normalize_newlines(F.coalesce(native, other))).drop("_other")
    return out.withColumn("reason", F.coalesce(refused, sanity_reason(F.col("text"))))


def sanity_reason(text: Column) -> Column:
    """Why a text is refused; NULL when it reads like text."""
    controls = F.regexp_count(text, F.lit(CONTROL_CHARS))
    return (
        F.when(text.isNull(), "undecodable")
        .when(js_trim(text) == "", "blank")
        .when(controls > F.greatest(F.lit(8.0), F.length(text) * 0.01), "control_chars")
    )


def normalize_charset(label: Column) -> Column:
    """A label that browsers know, in lower case and with usual names for GB18030 and UTF-8; NULL for any other."""
    name = F.regexp_replace(F.lower(js_trim(label)), "['\"]", "")
    known = name.rlike(rf"\A({'|'.join(LABELS.values())})\z")
    return F.when(name.isin(GB_LABELS), "gb18030").when(name == "utf8", "utf-8").when(known, name)


def sniff_charset(content_type: Column, content: Column) -> Column:
    """Header charset, else the one named in the head of the page (all that comes before its body), else UTF-8."""
    from_header = normalize_charset(F.regexp_extract(F.coalesce(content_type, F.lit("")), HEADER_CHARSET, 1))
    head = F.get(F.split(F.decode(content, "ISO-8859-1"), HEAD_END, 2), F.lit(0))
    meta = F.regexp_extract(head, META_CHARSET, 1)
    declared = F.regexp_extract(head, DECLARED_CHARSET, 1)
    in_page = normalize_charset(F.when(meta != "", meta).otherwise(declared))
    return F.coalesce(from_header, in_page, F.lit("utf-8"))
