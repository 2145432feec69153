"""Text functions: Column to Column, all of them built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


#: White space of any kind but a single plain space; no printable character of ASCII begins it.
GAP = "(?=[^!-~])(?: (?U)\\s+|(?U)[^\\S ]\\s*)"


def squeeze(x: Column | str) -> Column:
    """Runs of Unicode white space to one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x), F.lit("")), GAP, " "))


def cut_end(x: Column, chars: str) -> Column:
    """Without the given characters (of a regex class) at the end."""
    return F.regexp_replace(x, f"[{chars}]+$", "")


def cut_both(x: Column, chars: str) -> Column:
    return F.regexp_replace(x, f"^[{chars}]+|[{chars}]+$", "")


def n_words(x: Column | str) -> Column:
    """How many runs of non-space there are; squeezed, they have one space between them, so no array of them is built."""
    return let(squeeze(x), lambda s: F.when(s == "", 0).otherwise(F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1))


def some(x: Column) -> Column:
    """x, null where it is empty; x is computed once, where nullif computes it twice."""
    return let(x, lambda v: F.when(v != "", v))


def tokens(x: Column) -> Column:
    """Words of letters and digits with inner marks."""
    return F.regexp_extract_all(x, F.lit("[A-Za-z0-9][A-Za-z0-9'\\-/&]*"), F.lit(0))


#: Inline markup, in the order in which it goes.
INLINE = (
    ("!\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("!\\[([^\\]]*)\\]\\[[^\\]]*\\]", "$1"), ("\\[([^\\]]+)\\]\\([^)]*\\)", "$1"), ("\\[([^\\]]+)\\]\\[[^\\]]*\\]", "$1"), ("<[^<>]{1,80}>", ""),
    ("`+([^`]*)`+", "$1"), ("\\*\\*\\*(\\S(?:.*?\\S)?)\\*\\*\\*", "$1"), ("\\*\\*(\\S(?:.*?\\S)?)\\*\\*", "$1"), ("\\*(\\S(?:.*?\\S)?)\\*", "$1"), ("___(\\S(?:.*?\\S)?)___", "$1"),
    ("__(\\S(?:.*?\\S)?)__", "$1"), ("(?<![A-Za-z0-9_])_(\\S(?:.*?\\S)?)_(?![A-Za-z0-9_])", "$1"), ("~~(\\S(?:.*?\\S)?)~~", "$1"),
)


#: Characters without which no inline markup is found, and what shows that spacing or punctuation is not tidy yet.
MARKUP = "[\\[<`*_~]"
UNTIDY = "(?U)(?=[\\s.,;:])(?:[^\\S\\n ]|  |[ \\n][.,;:!?]|[.,;:]{2})"


def clean_inline(x: Column | str) -> Column:
    """One line without comments, inline markup and bare addresses, its spacing and punctuation tidied.

    Most lines have nothing of the kind: each group of patterns is tried only where one look at the line finds what all of them need.
    """

    def without_markup(x: Column) -> Column:
        out = F.regexp_replace(x, "(?s)<!--.*?-->", " ")
        for pattern, to in INLINE:
            out = F.regexp_replace(out, pattern, to)
        return out

    def tidied(x: Column) -> Column:
        out = F.trim(F.regexp_replace(x, "(?U)[^\\S\\n]+", " "))
        out = F.regexp_replace(out, "(?U)\\s+([.,;:!?])", "$1")
        out = F.regexp_replace(out, "([.,;:])\\1+", "$1")
        return F.trim(F.regexp_replace(out, "([.;:]),", "$1"))

    bare = let(F.coalesce(_col(x), F.lit("")), lambda v: F.when(v.rlike(MARKUP), without_markup(v)).otherwise(v))
    bare = let(bare, lambda v: F.when(v.contains("http"), F.regexp_replace(v, "(?<![(\\w])https?://\\S+", "")).otherwise(v))
    return let(bare, lambda v: F.when(v.rlike(UNTIDY), tidied(v)).otherwise(F.trim(v)))


#: No decoration stands before this character.
HIGH = "[\\x{200D}-\\x{10FFFF}]"


def strip_decoration(x: Column) -> Column:
    """Without emoji, pictographs and other symbols above U+2000, keeping the technical ones."""
    blocks = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE00}-\\x{FE0F}\\x{200D}\\x{2190}-\\x{21FF}\\x{2300}-\\x{23FF}\\x{24C2}]"
    return F.regexp_replace(F.regexp_replace(x, blocks, ""), "[\\x{2001}-\\x{10FFFF}&&\\p{So}&&[^™]]|\\x{FEFF}", "")


def undecorated(x: Column) -> Column:
    """A line that ``clean_inline`` gave, without decoration; only where there may be some, spaces are joined anew."""
    return F.when(x.rlike(HIGH), F.trim(F.regexp_replace(strip_decoration(x), "(?U)[^\\S\\n]+", " "))).otherwise(x)


def plain(x: Column | str) -> Column:
    return let(clean_inline(x), undecorated)


BULLET = "^\\s*(?:[-*•‣▪●◦o>])\\s+"
NUMBERED = "^\\s*(\\d{1,2}|[ivxlc]+)[.)\\]]\\s*(.*)$"


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def is_caption(line: Column) -> Column:
    return line.startswith(lex.CAPTION_MARK)


def numbered_rest(line: Column) -> Column:
    """What follows a numbered marker, null without one."""
    return F.when(line.rlike(NUMBERED), F.trim(F.regexp_extract(line, NUMBERED, 2)))


def unmarked(line: Column) -> Column:
    return F.trim(F.replace(line, F.lit(lex.HEADING_MARK), F.lit("")))


def is_metadata(line: Column) -> Column:
    """An author line, or a line with a date (any bare number of four digits is one)."""
    return unmarked(line).rlike(lex.AUTHOR) | has_date(unmarked(line))


def has_date(line: Column) -> Column:
    """Whether there is a date; each form of one has a digit, which is looked for first."""
    return line.rlike("[0-9]") & line.rlike(lex.DATE)


def header_rules(line: Column) -> Column:
    """The heading rules that look at the line alone, in order: ``told``, null where none decides, and ``titled``, whether the line could head what follows.

    The line is trimmed and not empty.
    """
    n, rest = n_words(line), numbered_rest(line)
    first = cut_end(F.lower(F.regexp_extract(line, "^(\\S+)", 1)), ".:,;")
    strong = first.isin(lex.STRONG_HEADINGS)
    shout = line.rlike("\\p{Lu}") & ~line.rlike("\\p{Ll}") & (n <= 10) & (F.length(line) <= 90)
    titled = (F.length(line) <= 90) & (n <= 10) & line.rlike("^\\p{Lu}") & ~line.rlike("[.,;!?]$")
    told = (
        F.when(line.startswith(lex.HEADING_MARK), True)
        .when(is_caption(line) | is_bullet(line), False)
        .when(rest.isNotNull(), ~(rest.endswith(".") & (n_words(rest) > 5)) & (n_words(rest) <= 9))
        .when(shout, True)
        .when(strong & (n <= 12) & (~line.endswith(".") | (n <= 5)), True)
        .when(line.rlike("^(?:Section|Chapter|Part|Module)"), True)
        .when(line.endswith(":") & (n <= 8), True)
    )
    return F.struct(told.alias("told"), titled.alias("titled"))


def leads(following: Column) -> Column:
    """Whether the next raw line can stand under a heading."""
    return F.coalesce((following != "") & (is_bullet(following) | (n_words(following) >= 4)), F.lit(False))


def is_header(line: Column, following: Column) -> Column:
    """Whether a trimmed line that is not empty is a heading; ``following`` is the next raw line or null."""
    return let(header_rules(line), lambda r: F.coalesce(r["told"], r["titled"] & leads(following)))


def heading_text(line: Column) -> Column:
    rest = numbered_rest(line)
    return F.when(rest.isNotNull(), cut_end(squeeze(rest), ".:")).otherwise(cut_end(unmarked(line), ".:"))


def whole_words(alternatives: str) -> str:
    """A pattern of whole words, each of which begins with a small letter, grouped by it: most places of a text fail at one look."""
    groups: dict[str, list[str]] = {}
    for a in re.split("\\|(?![^(]*\\))", alternatives):
        groups.setdefault(a[0], []).append(a[1:])
    either = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())
    return f"(?=[{''.join(groups)}])\\b(?:{either})\\b"


def section_type(text: Column) -> Column:
    return F.when(F.lower(text).rlike(whole_words(lex.PRACTICAL_SECTION)), "practical").otherwise("theory")


def point_theme(point: Column) -> Column:
    return F.when(point.rlike(f"(?i){whole_words(lex.PRACTICAL_POINT)}"), "practical").otherwise("theory")


#: The space after . ! ? and before a capital, digit, quote or bracket.
SENTENCE_CUT = " (?<=[.!?] )(?=[A-Z0-9\"'(])"


def sentences(x: Column | str) -> Column:
    """Cut after . ! ? before a capital, digit, quote or bracket."""
    return F.filter(F.split(squeeze(x), SENTENCE_CUT), lambda s: s != "")


def packed_line(line: Column, most: int = 220) -> Column:
    """pack(sentences(line)): a line that fits as a whole is not cut first. An empty one may stay as an empty part."""
    return let(squeeze(line), lambda s: F.when(F.octet_length(s) <= most, F.array(s)).otherwise(pack(F.split(s, SENTENCE_CUT), most)))


def pack(parts: Column, most: int = 220) -> Column:
    """Join neighbouring parts with a space as long as they fit ``most`` characters, in order."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(a: Column, s: Column) -> Column:
        full = F.struct(F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"]))).alias("done"), s.alias("held"))
        joined = F.when(a["held"] == "", s).otherwise(F.concat(a["held"], F.lit(" "), s))
        return let(joined, lambda both: F.when(F.length(both) <= most, F.struct(a["done"].alias("done"), both.alias("held"))).otherwise(full))

    return F.aggregate(parts, start, step, lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"]))))


def label_of(point: Column) -> Column:
    """The label of a ``Label: text`` point, null where it has none or one that names only a variant."""
    raw = F.regexp_extract(point, "^([A-Z][A-Za-z0-9&/'\\-]*(?:[ ][A-Za-z0-9&/'\\-]+){0,5}):(?:\\s|$)", 1)
    bad = lambda x: (x == "") | (F.size(tokens(x)) > lex.TITLE_WORDS) | F.lower(x).isin(lex.GENERIC_HEADINGS) | x.rlike(lex.VARIANT_LABEL)
    return F.when(point.contains(":"), let(raw, lambda r: F.when(r != "", let(cut_both(squeeze(r), " .:-"), lambda x: F.when(~bad(x), x)))))


def usable_title(x: Column, fallback: Column | None = None) -> Column:
    """A heading fit for a slide, cut to nine words; the fallback for a generic or empty one."""
    fallback = F.lit("") if fallback is None else fallback

    def of(x: Column, w: Column) -> Column:
        short = cut_end(F.array_join(F.slice(w, 1, lex.TITLE_WORDS), " "), " ,;:")
        return F.when((x == "") | F.lower(x).isin(lex.GENERIC_HEADINGS) | (F.size(w) == 0), fallback).when((F.size(w) > lex.TITLE_WORDS) | (F.length(x) > 90), short).otherwise(x)

    return let(cut_both(squeeze(x), " .:\\-#"), lambda v: let(tokens(v), lambda w: of(v, w)))


PART_MARK = "(?:[—–-]\\s*Part\\s*\\d+|\\(\\d+\\))\\s*$"
PART_SUFFIX = "\\s*(?:\\(\\d+\\)|[—–-]\\s*Part\\s*\\d+)$"


def clean_title(x: Column) -> Column:
    """Eight words at most, with a part marker kept."""

    def of(whole: Column, mark: Column) -> Column:
        body = F.when(mark == "", whole).otherwise(cut_end(F.trim(F.regexp_replace(whole, PART_MARK, "")), ".:;"))
        name = lambda w: F.when(F.size(w) == 0, "Topic Overview").otherwise(F.concat_ws(" ", F.array_join(F.slice(w, 1, 8), " "), F.when(mark != "", mark)))
        return let(F.filter(F.split(body, " "), lambda s: s != ""), name)

    return let(cut_end(squeeze(x), ".:;"), lambda v: let(F.trim(F.regexp_extract(v, PART_MARK, 0)), lambda m: of(v, m)))


def base_heading(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, PART_MARK, ""))


def last_place(x: Column, mark: str) -> Column:
    """Characters before the last occurrence of mark, -1 without one."""
    return F.when(F.instr(x, mark) > 0, F.length(x) - F.length(F.substring_index(x, mark, -1)) - len(mark)).otherwise(-1)


def clip(x: Column) -> Column:
    """Over 30 words of a squeezed text: cut at the last sentence or clause end, else comma, that leaves ten words; else unchanged."""

    def of(c: Column) -> Column:
        comma = lambda p: let(F.substring(c, F.lit(1), p), lambda tail: F.when((p > 0) & (n_words(tail) >= 10), F.concat(cut_end(tail, " ,;:"), F.lit("."))).otherwise(x))
        enough = lambda p: (p > 0) & (n_words(F.substring(c, F.lit(1), p)) >= 10)
        sentence = lambda p: F.when(enough(p), F.concat(F.rtrim(F.substring(c, F.lit(1), p + 1)), F.lit("."))).otherwise(let(last_place(c, ", "), comma))
        return let(F.greatest(*(last_place(c, m) for m in (". ", "; ", " — "))), sentence)

    # words of a squeezed text have one space between them
    return let(F.substring_index(x, " ", lex.MAX_WORDS), lambda c: F.when(F.octet_length(c) < F.octet_length(x), of(c)).otherwise(x))


def refine_bullet(x: Column) -> Column:
    """Sentence case (all but sentence openings in lower case), one closing mark, at most about 30 words; null when empty."""

    def opened(low: Column) -> Column:
        parts = F.split(low, "(?<=\\. )(?=[a-z])")
        told = F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)), "")
        return F.when(low.contains(". "), told).otherwise(low)

    def of(v: Column) -> Column:
        # of ß and the like the first capital is two letters, of which one stays a capital
        low = let(F.upper(F.substring(v, 1, 1)), lambda f: F.concat(F.substring(f, 1, 1), F.lower(F.concat(F.substring(f, 2, 2), F.substring(v, 2, 1 << 30)))))
        closed = lambda c: F.when(c.endswith(".") | c.endswith("!") | c.endswith("?"), c).otherwise(F.concat(c, F.lit(".")))
        return let(let(let(low, opened), closed), clip)

    return let(squeeze(F.ltrim(x, F.lit("•-* \t\n\x0b\f\r"))), lambda v: F.when(v != "", of(v)))


def shorten_recap(x: Column, most: int = lex.RECAP_CHARS) -> Column:
    """A long line to its first sentence, clause or words within the limit."""
    head = F.substring(x, 1, most + 2)
    stop = F.length(F.regexp_extract(head, "^(.*?\\.)\\s+(?=[A-Z])", 1))
    cuts = [F.instr(x, m) - 1 for m in ("; ", ", and ", ", which ", ", so ")]
    out = F.when(F.length(x) <= most, x).when(stop > 0, F.rtrim(F.substring(x, F.lit(1), stop)))
    for c in cuts:
        out = out.when((c > 0) & (c <= most), F.concat(F.rtrim(F.substring(x, F.lit(1), c)), F.lit(".")))
    return out.otherwise(F.concat(F.regexp_replace(F.substring(x, 1, most - 1), " [^ ]*$", ""), F.lit("...")))


def match_tokens(x: Column) -> Column:
    """Distinct subject words, in lower case, in order."""
    found = F.array_join(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9\\-]{2,}"), F.lit(0)), " ")
    return F.array_except(F.split(F.lower(found), " "), F.array(*map(F.lit, ["", *lex.MATCH_STOPWORDS])))


def heading_key(x: Column) -> Column:
    """A heading without number, tail and noise words."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), "^\\s*(?:\\d+(?:\\.\\d+)*[.)]?|[IVXLC]+[.)])\\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, "\\s*[:–—-]\\s*.*$", ""), "\\s*\\([^)]*\\)", "")
    return F.array_join(F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(lex.HEADING_NOISE)), " ")


def caption_key(x: Column) -> Column:
    """A caption without its label and numbers."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.filter(found, lambda w: ~w.isin(lex.CAPTION_LABELS) & ~w.rlike("^[0-9]+$")), " ")


def image_keywords(*parts: Column) -> Column:
    """The first three subject words, else 'presentation'."""
    found = F.slice(match_tokens(F.concat_ws(" ", *parts)), 1, 3)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("presentation")))


def image_url(keywords: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.url_encode(F.array_join(F.slice(keywords, 1, 3), " ")))


def strip_fences(x: Column) -> Column:
    """Model output without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), "^```[A-Za-z]*\\s*", ""), "\\s*```$", ""))


def duration_seconds(x: Column) -> Column:
    """Seconds in texts such as 1m30s, 500ms or 2h; null where there is no such part."""
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    total = F.lit(0.0)
    for name, factor in unit.items():
        found = F.regexp_extract_all(x, F.lit(f"([0-9]+(?:\\.[0-9]+)?){name}(?![a-z])"), F.lit(1))
        total = total + F.aggregate(found, F.lit(0.0), lambda a, v: a + v.cast("double")) * F.lit(factor)
    return F.when(x.rlike("[0-9](?:ms|[hms])(?![a-z])"), total)


def formatted_runs(x: Column) -> Column:
    """Runs of **bold**, --highlighted-- and __italic__ text and what is in between, in order: array of (style, text)."""
    marks = "(\\*\\*[^*]+\\*\\*|--[^-]+--|__[^_]+__)"
    cut = F.split(F.regexp_replace(x, marks, "\u0001$1\u0001"), "\u0001")
    kept = F.filter(cut, lambda p: p != "")

    def of(p: Column) -> Column:
        inner = F.substring(p, F.lit(3), F.greatest(F.length(p) - 4, F.lit(0)))
        styled = lambda m: p.startswith(m) & p.endswith(m) & (F.length(p) > 4)
        style = F.when(styled("**"), "bold").when(styled("--"), "highlight").when(styled("__"), "italic").otherwise("plain")
        return F.struct(style.alias("style"), F.when(style == "plain", p).otherwise(inner).alias("text"))

    return F.transform(kept, of)


def touches_front_matter(x: Column) -> Column:
    low = cut_end(F.lower(squeeze(F.regexp_replace(x, "\u00ad", ""))), ".:")
    phrases = F.array(*map(F.lit, lex.FRONT_MATTER))
    return let(low, lambda w: (w != "") & F.exists(phrases, lambda p: (w == p) | w.startswith(F.concat(p, F.lit(" "))) | w.endswith(p)))


def is_contents_line(x: Column) -> Column:
    """A table-of-contents entry or a bare Roman page number."""
    return x.rlike("^\\s*.+?(?:\\.{2,}|\\s{2,}|\\s·\\s{2,}).*?(?:\\d{1,4})\\s*$") | F.trim(x).rlike("(?i)^\\s*[ivxlcdm]{1,7}\\s*$")


def is_numbered_heading(x: Column) -> Column:
    named = x.rlike("(?i)^\\s*(?:chapter|section|part|module|unit|annex)\\s+[\\dIVXivx]+")
    rest = F.regexp_extract(x, "^\\s*(\\d{1,2}(?:\\.\\d{1,2})*)[.)]?\\s+(\\S.*)$", 2)
    return named | ((rest != "") & (n_words(rest) <= 9) & ~rest.endswith("."))


def clean_point(x: Column) -> Column:
    """A point without bold marks and rules; a stock line where nothing is left."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\\*\\*(.*?)\\*\\*", "$1"), "[_\\-]{2,}", " "))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("Key information point"))


def preserve_structure(x: Column) -> Column:
    """Pasted text with its lines: endings as \\n, no control characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))


def strict_clean(x: Column) -> Column:
    """Letters, digits, @ and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^a-zA-Z0-9\\s@]", ""), "\\s+", " "))


def iso_time(x: Column) -> Column:
    """A timestamp as ISO text, with microseconds only where there are some."""
    micros = F.unix_micros(x.cast("timestamp")) % 1000000
    return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""))


def document_summary(pages: Column, text: Column, front: Column, figures: Column) -> Column:
    """One line that tells what was read."""
    return F.format_string("%d pages, %d words of body text, %d words of front matter, %d visuals", pages, n_words(text), n_words(front), figures)
