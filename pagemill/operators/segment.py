"""Long raw texts -> sections, by chapter headings or by length.

Everything about one text happens inside its row, without a shuffle. Texts are cut at headings by
one regex split, so the work grows with the text and the number of headings, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, WS_INLINE, js_trim, let, normalize_newlines, prefix_sums

# Sizes in characters, and titles given to unnamed parts.
TITLE_LIMIT = 80
MIN_CHUNK, TARGET_CHUNK, MAX_CHUNK = 4000, 6000, 8000
MAX_SECTION = 20000
FRONT_TITLE = "前言"
BODY_TITLE = "正文"
SENTENCE_END = "[。！？.!?]"
TOC_GAP, TOC_MIN_RUN, TOC_MAX_START, TOC_MAX_SHARE = 40, 4, 5000, 0.2
LONE_MAX_START, LONE_MAX_SHARE = 2000, 0.25

# What a heading line looks like (\s is any web white space).
NUMBERED = r"第\s*[0-9０-９零〇一二三四五六七八九十百千万两]+\s*"
NAME = r"(?:\s*|\s*[：:、.．\-—]\s*[^。！？!?]{1,48}|\s+[^。！？!?]{1,48})"
CHAPTER = rf"(?:正文\s*)?{NUMBERED}[章回节]{NAME}"
ENGLISH = r"(?i:chapter\s+(?:\d+|[ivxlcdm]+)(?:\s*|\s*[.:：\-—]\s*[^.!?]{1,48}|\s+[^.!?]{1,48}))"
SPECIAL = (
    r"(?:序章|序言|前言|楔子|引子|尾声|后记|番外)"
    r"(?:[0-9０-９一二三四五六七八九十百千万]+|(?:\s*[：:、.．\-—]\s*|\s+)[^。！？!?]{1,30})?"
)
VOLUME = rf"{NUMBERED}[卷部篇]{NAME}"


def _one_line(pattern: str) -> str:
    """The pattern with white space and negated classes kept from crossing a line end."""
    return pattern.replace(r"\s", f"[{WS_INLINE}]").replace("[^。", r"[^\n。").replace("[^.", r"[^\n.")


def heading_regex(*kinds: str, limited: bool = True) -> str:
    """A Java regex for a whole heading line, to be tried at a line's start."""
    blank = f"[{WS_INLINE}]*"
    line_end = r"(?=\n|\z)"
    # The kinds come first: they fail at once on most lines, the length test does not.
    limit = rf"(?=[^{WS}](?:[^\n]{{0,{TITLE_LIMIT - 2}}}[^{WS}])?{blank}{line_end})" if limited else ""
    return f"{blank}+(?=(?:{'|'.join(_one_line(k) for k in kinds)}){blank}{line_end}){limit}"


MAIN = rf"(?:\A|\n){heading_regex(CHAPTER, ENGLISH, limited=False)}"
WITHOUT_VOLUMES = heading_regex(CHAPTER, ENGLISH, SPECIAL)
WITH_VOLUMES = heading_regex(CHAPTER, ENGLISH, SPECIAL, VOLUME)


def line_table(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines with half-open offsets, the line end included."""
    parts = F.split(F.col(text), "\n", -1)
    rows = df.select(*keys, parts.alias("_l"))
    rows = rows.withColumn(
        "_n", F.transform("_l", lambda x, i: F.length(x) + F.when(i < F.size("_l") - 1, 1).otherwise(0))
    )
    rows = rows.withColumn("_s", prefix_sums(F.col("_n")))
    zipped = F.arrays_zip(F.col("_l").alias("line"), F.col("_s").alias("start"), F.col("_n").alias("n"))
    return rows.select(*keys, F.posexplode(zipped).alias("line_no", "z")).select(
        *keys, "line_no", F.col("z.line").alias("line"), F.col("z.start").alias("start"), (F.col("z.start") + F.col("z.n")).alias("end")
    )


def _points(text: Column, heading: str) -> Column:
    def build(parts: Column) -> Column:
        # Each cut swallowed the line end in front of its heading.
        starts = prefix_sums(F.transform(parts, lambda p: F.length(p) + 1))

        def one(p: Column, i: Column) -> Column:
            head = F.substring_index(p, "\n", 1)
            rest = F.substring(p, F.length(head) + 2, F.length(p))
            return F.struct(
                F.get(starts, i).alias("start"), js_trim(head).alias("title"), F.length(js_trim(rest)).alias("gap")
            )

        found = F.transform(parts, one)
        from_start = F.get(parts, F.lit(0)).rlike(rf"\A{heading}")
        return F.when(from_start, found).otherwise(F.slice(found, 2, F.greatest(F.size(parts) - 1, F.lit(0))))

    return let(F.split(text, rf"\n(?={heading})", -1), build)


def points(text: Column) -> Column:
    """Headings as ARRAY<STRUCT<start, title, gap>>; gap is the trimmed length up to the next heading.

    Volume lines count only in texts without chapter headings.
    """
    plain, volumes = _points(text, WITHOUT_VOLUMES), _points(text, WITH_VOLUMES)
    return F.when(F.regexp_like(text, F.lit(MAIN)), plain).otherwise(volumes)


def toc_run(found: Column, length: Column) -> Column:
    """How many headings in a row, from the first, look like lines of a leading table of contents."""
    limit = F.least(F.lit(float(TOC_MAX_START)), length * TOC_MAX_SHARE)
    n = F.size(found)
    broken = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
        lambda i: (F.get(found, i)["start"] > limit) | (F.get(found, i)["gap"] > TOC_GAP),
    )
    return F.when(n >= 2, F.coalesce(F.array_min(broken), n - 1)).otherwise(F.lit(0))


def next_cut(w: Column) -> Column:
    """Length of the next chunk, given the following 8000 characters of a longer rest.

    The line end nearest to 6000 wins (a later one on a tie), then the first sentence end after,
    then the last one before, within 4000 to 8000; else 6000.
    """
    ahead = F.locate("\n", w, TARGET_CHUNK)
    back = F.locate("\n", F.reverse(F.substring(w, MIN_CHUNK, TARGET_CHUNK - MIN_CHUNK)))
    stop = F.regexp_instr(F.substring(w, TARGET_CHUNK, MAX_CHUNK - TARGET_CHUNK + 1), F.lit(SENTENCE_END))
    stop_back = F.regexp_instr(F.reverse(F.substring(w, MIN_CHUNK, TARGET_CHUNK - MIN_CHUNK + 1)), F.lit(SENTENCE_END))
    return (
        F.when((ahead > 0) & ((back == 0) | (ahead - TARGET_CHUNK <= back)), ahead)
        .when(back > 0, F.lit(TARGET_CHUNK) - back)
        .when(stop > 0, stop + (TARGET_CHUNK - 1))
        .when(stop_back > 0, F.lit(TARGET_CHUNK + 1) - stop_back)
        .otherwise(F.lit(TARGET_CHUNK))
    )


def blocks_of(text: Column) -> Column:
    """The text in blocks of 8000. Places deep inside a long text are then found without reading it
    from its beginning each time."""
    whole = F.length(text) <= MAX_CHUNK
    return F.when(whole, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{MAX_CHUNK}}}"), F.lit(0)))


def stretch(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end``, read from the blocks that hold them."""
    first = F.floor(start / MAX_CHUNK).cast("int")
    last = F.floor((end - 1) / MAX_CHUNK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(joined, start - first * MAX_CHUNK + 1, end - start)


def cuts(text: Column) -> Column:
    """End offsets of the chunks of one text; each step looks at two blocks."""
    n = F.length(text)

    def fold(blocks: Column) -> Column:
        def window(pos: Column) -> Column:
            b = F.floor(pos / MAX_CHUNK).cast("int")
            two = F.concat(F.get(blocks, b), F.coalesce(F.get(blocks, b + 1), F.lit("")))
            return F.substring(two, pos % MAX_CHUNK + 1, F.lit(MAX_CHUNK))

        def step(state: Column, _: Column) -> Column:
            pos = state["pos"]
            end = F.when(n - pos <= MAX_CHUNK, n).otherwise(pos + let(window(pos), next_cut))
            return F.when(pos >= n, state).otherwise(
                let(end, lambda e: F.struct(e.alias("pos"), F.array_append(state["cuts"], e).alias("cuts")))
            )

        zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("cuts"))
        rounds = F.sequence(F.lit(1), F.ceil(n / MIN_CHUNK).cast("int"))
        return F.aggregate(rounds, zero, step)["cuts"]

    return F.when(n <= MAX_CHUNK, F.array(n)).otherwise(let(blocks_of(text), fold))


def _parts(blocks: Column, section: Column) -> Column:
    """A section as it is, or when too long as numbered chunks."""
    start, end, title = section["start"], section["end"], section["title"]

    def number(ends: Column) -> Column:
        return F.transform(
            ends,
            lambda e, k: F.struct(
                F.concat(title, F.lit("（"), (k + 1).cast("string"), F.lit("）")).alias("title"),
                F.when(k == 0, start).otherwise(start + F.get(ends, k - 1)).alias("start"),
                (start + e).alias("end"),
            ),
        )

    long_form = let(let(stretch(blocks, start, end), cuts), number)
    return F.when(end - start > MAX_SECTION, long_form).otherwise(F.array(section))


def by_length(text: Column) -> Column:
    """Chunks of a text without usable headings."""
    n = F.length(text)

    def number(ends: Column) -> Column:
        return F.transform(
            ends,
            lambda e, k: F.struct(
                F.when(n <= MAX_SECTION, F.lit(BODY_TITLE))
                .otherwise(F.concat(F.lit("第 "), (k + 1).cast("string"), F.lit(" 节")))
                .alias("title"),
                F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1)).alias("start"),
                e.alias("end"),
            ),
        )

    return let(cuts(text), number)


def by_headings(text: Column, kept: Column) -> Column:
    """Sections from the kept headings, text before the first one as front matter."""
    n = F.length(text)
    first = F.get(kept, F.lit(0))["start"]
    front = F.struct(F.lit(FRONT_TITLE).alias("title"), F.lit(0).alias("start"), first.alias("end"))
    has_front = (first > 0) & (js_trim(F.substring(text, F.lit(1), first)) != "")
    own = F.transform(
        kept,
        lambda p, i: F.struct(
            p["title"].alias("title"), p["start"].alias("start"), F.coalesce(F.get(kept, i + 1)["start"], n).alias("end")
        ),
    )
    sections = F.when(has_front, F.concat(F.array(front), own)).otherwise(own)
    return let(blocks_of(text), lambda b: F.flatten(F.transform(sections, lambda s: _parts(b, s))))


def outline(text: Column) -> Column:
    """STRUCT<points, toc_run, kept>: all headings, and those left without a leading contents list."""

    def judge(found: Column) -> Column:
        def cut(run: Column) -> Column:
            kept = F.when(run >= TOC_MIN_RUN, F.slice(found, run + 1, F.size(found))).otherwise(found)
            return F.struct(found.alias("points"), run.alias("toc_run"), kept.alias("kept"))

        return let(toc_run(found, F.length(text)), cut)

    return let(points(text), judge)


def unreliable(kept: Column, length: Column) -> Column:
    """No heading at all, or a single one deep inside the text."""
    deep = F.get(kept, F.lit(0))["start"] > F.least(F.lit(float(LONE_MAX_START)), length * LONE_MAX_SHARE)
    return (F.size(kept) == 0) | ((F.size(kept) == 1) & deep)


def sections_of(text: Column) -> Column:
    """STRUCT<split_method, sections> of one normalized text."""

    def divide(kept: Column) -> Column:
        by_len = F.struct(F.lit("length").alias("split_method"), by_length(text).alias("sections"))
        by_head = F.struct(F.lit("headings").alias("split_method"), by_headings(text, kept).alias("sections"))
        return F.when(unreliable(kept, F.length(text)), by_len).otherwise(by_head)

    return let(outline(text)["kept"], divide)


def segment(df: DataFrame, text: str = "text", mode: str = "auto") -> DataFrame:
    """Add ``split_method`` and ``sections`` ARRAY<STRUCT<title, start, end>>; blank texts are left out.

    The text column is replaced by its normalized form, to which the offsets refer.
    """
    out = df.withColumn(text, normalize_newlines(F.col(text))).where(js_trim(F.col(text)) != "")
    if mode == "length":
        return out.withColumns({"split_method": F.lit("length"), "sections": by_length(F.col(text))})
    kept = [c for c in out.columns if c not in ("split_method", "sections")]
    return out.withColumn("_seg", sections_of(F.col(text))).select(*kept, "_seg.split_method", "_seg.sections")


def section_rows(segmented: DataFrame, keys: list[str], text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per section, numbered from 0, with its text unless told otherwise.

    The rows are built inside the text's row and then unfolded, so the text is not copied once per
    section.
    """

    def rows(blocks: Column | None) -> Column:
        def one(s: Column, i: Column) -> Column:
            body = [] if blocks is None else [stretch(blocks, s["start"], s["end"]).alias("section_text")]
            return F.struct(i.alias("idx"), s["title"].alias("title"), s["start"].alias("start"), s["end"].alias("end"), *body)

        return F.transform("sections", one)

    unfolded = let(blocks_of(F.col(text)), rows) if with_text else rows(None)
    return segmented.select(*keys, "split_method", F.inline(unfolded))


def chapter_id(idx: Column) -> Column:
    return F.lpad((idx + 1).cast("string"), 6, "0")


# Fixed value: said of a text that was split by length though headings were looked for.
BY_LENGTH_WARNING = "未识别到可靠章节标题，已按长度自动分段"


def warnings(mode: str = "auto") -> Column:
    """What to tell about a segmented text: nothing, or that no reliable headings were found in it."""
    by_length = F.array(F.lit(BY_LENGTH_WARNING))
    none = F.array().cast("array<string>")
    return F.when((F.col("split_method") == "length") & F.lit(mode in ("auto", "length")), by_length).otherwise(none)


def manifest(
    segmented: DataFrame, keys: list[str], text: str = "text", encoding: Column | None = None, mode: str = "auto"
) -> DataFrame:
    """One row per text: content hash, encoding, split method, warnings, section count, the list of ids and titles, last
    title and id, unread count."""
    n = F.size("sections")
    return segmented.select(
        *keys,
        F.sha2(F.col(text), 256).alias("content_hash"),
        (F.lit("utf-8") if encoding is None else encoding).alias("encoding"),
        "split_method",
        warnings(mode).alias("warnings"),
        n.alias("n_sections"),
        F.transform("sections", lambda s, i: F.struct(chapter_id(i).alias("id"), s["title"].alias("title"))).alias("chapters"),
        F.element_at("sections", -1)["title"].alias("latest_chapter"),
        chapter_id(n - 1).alias("last_chapter_id"),
        F.greatest(F.lit(0), n - 1).alias("unread_count"),
    )


def dedupe_by_hash(df: DataFrame, key: str, text: str = "text", imported: DataFrame | None = None) -> DataFrame:
    """One row per distinct text: which key is imported and how many copies it stands for.

    Only hashes and keys are shuffled, combined per task first. ``imported`` holds the content_hash
    of books already there; their texts need no import.
    """
    hashed = df.select(F.col(key), F.sha2(normalize_newlines(F.col(text)), 256).alias("content_hash"))
    out = hashed.groupBy("content_hash").agg(F.min(key).alias(key), F.count("*").alias("n_copies"))
    if imported is None:
        return out
    return out.join(imported.select("content_hash"), "content_hash", "left_anti")


def import_plan(df: DataFrame, key: str, books: DataFrame, chapters: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct text: ``key`` of the row that stands for it, ``n_copies``, ``book_id`` of the book that already
    holds it, and ``action``: 'import' a new text, 'open' the book, or 'replace' a book whose chapters are gone.

    ``books`` has id and content_hash (of several with one text the smallest id counts), ``chapters`` book_id, idx and
    content. A book is intact if its first chapter is there and not blank. Only hashes and keys are shuffled.
    """
    copies = dedupe_by_hash(df, key, text)
    held = books.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("id").alias("book_id"))
    whole = chapters.where((F.col("idx") == 0) & (js_trim(F.coalesce("content", F.lit(""))) != "")).select("book_id").distinct()
    known = held.join(whole.withColumn("_whole", F.lit(True)), "book_id", "left")
    action = F.when(F.col("book_id").isNull(), "import").when(F.col("_whole"), "open").otherwise("replace")
    return copies.join(known, "content_hash", "left").select("content_hash", key, "n_copies", "book_id", action.alias("action"))
