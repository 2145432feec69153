"""Arithmetic functions: rounding, slots, colours, scores and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions.text import let


def distribution(slide_count: Column, theory_percent: Column, image_percent: Column, words: Column) -> Column:
    """Struct of slide counts, rounded half to even, and a warning for a short text."""
    content = F.greatest(slide_count - lex.STRUCTURAL_SLIDES, F.lit(1))
    part = lambda p: F.bround(content * (p / F.lit(100.0)), 0).cast("int")
    text = F.concat(F.lit("Input may be too short ("), words.cast("string"), F.lit(" words) for "), slide_count.cast("string"), F.lit(" slides. Slides will carry fewer lines each so nothing has to be repeated."))
    return F.struct(
        slide_count.cast("int").alias("total_slides"), content.cast("int").alias("content_slides"), part(theory_percent).alias("theory_slides"), (content - part(theory_percent)).cast("int").alias("practical_slides"),
        F.least(content, part(image_percent)).cast("int").alias("image_slides"), F.when(words < content * lex.WORDS_PER_SLIDE, text).alias("warning"),
    )


def spread(total: Column, k: Column) -> Column:
    """k positions spread over 0..total-1, sorted and distinct; none for k of 0 or less."""
    at = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.least(total - 1, F.rint(i * (total / k)).cast("int")))
    return F.when(k > 0, F.array_sort(F.array_distinct(at))).otherwise(F.array().cast("array<int>"))


def channel(colour: Column, at: int) -> Column:
    return F.conv(F.substring(F.replace(colour, F.lit("#"), F.lit("")), 1 + 2 * at, 2), 16, 10).cast("int")


def luminance(colour: Column) -> Column:
    return 0.299 * channel(colour, 0) + 0.587 * channel(colour, 1) + 0.114 * channel(colour, 2)


def contrast(colour: Column, dark: str = "#000000", light: str = "#FFFFFF") -> Column:
    return F.when(luminance(colour) < 140, light).otherwise(dark)


def tint(colour: Column, factor: float) -> Column:
    """Toward white, truncating."""
    part = lambda c: F.lpad(F.hex((c + (255 - c) * F.lit(factor)).cast("int").cast("long")), 2, "0")
    return F.concat(F.lit("#"), *(part(channel(colour, i)) for i in range(3)))


def relevance(texts: Column, query: Column) -> Column:
    """Share of the query's tokens that the text's tokens hold; 0 without any."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(texts, query)) / F.size(query)).otherwise(0.0)


def candidate_score(rel: Column, width: Column, height: Column, ratio: Column) -> Column:
    """Lower is better; null where the size is not known."""
    off = F.abs(width / height - ratio) / F.greatest(ratio, F.lit(1e-6))
    return F.when((width > 0) & (height > 0), (1 - rel) + 0.35 * F.least(off, F.lit(2.0)))


def figure_score(figure: Column, slide: Column) -> Column:
    """Coverage of the figure's distinct tokens by the slide's, times the root of up to four shared ones; 0 below the thresholds."""

    def of(shared: Column) -> Column:
        coverage = shared / F.size(figure)
        ok = (F.size(figure) > 0) & (shared > 0) & (coverage >= 0.34) & ~((shared < 2) & (F.size(figure) > 2))
        return F.when(ok, coverage * F.sqrt(F.least(shared, F.lit(4)).cast("double"))).otherwise(0.0)

    return let(F.size(F.array_intersect(slide, figure)), of)


def affinity(figure_key: Column, slide_key: Column) -> Column:
    """Bonus of a figure from the slide's section: 2 for the same heading, 1.6 for one that begins with the other."""
    near = slide_key.startswith(figure_key) | figure_key.startswith(slide_key)
    return F.when((figure_key == "") | (slide_key == ""), 0.0).when(figure_key == slide_key, 2.0).when(near, 1.6).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length, not below 0."""
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def back_off(delay: Column, attempt: Column) -> Column:
    """Seconds to wait: what the server says, else 2 to the attempt, 30 at most (without jitter)."""
    return F.least(F.coalesce(delay, F.pow(F.lit(2.0), attempt)), F.lit(30.0))


def fitted_size(bullets: Column, width: float, height: float, base: float, least: float) -> Column:
    """The largest font size, by half points from base down to least, at which the lines fit the box.

    What a size holds does not depend on the lines: characters a row, and rows. Lines are measured
    once, and a size is tried only where no larger one fits.
    """
    room = lambda em: float(max(int(width * 72 / (0.55 * em)), 8))
    tall = lambda n, size: (n * size * 1.22 + max(3.0, size * 0.45) * max(n - 1, 0)) / 72

    def holds(size: float) -> int:
        n = -1
        while tall(n + 1, size) <= height * 0.94:
            n += 1
        return n

    sizes = [base - i / 2 for i in range(int((base - least) * 2) + 1)]
    known = F.array(*(F.struct(F.lit(float(s)).alias("size"), F.lit(room(s)).alias("plain"), F.lit(room(s + 3)).alias("bold"), F.lit(holds(s)).alias("most")) for s in sizes))

    def first(lines: Column) -> Column:
        each = lambda s: lambda a, b: a + F.greatest(F.lit(1).cast("long"), F.ceil(b["n"] / F.when(b["bold"], s["bold"]).otherwise(s["plain"])))
        fits = lambda s: F.aggregate(lines, F.lit(0).cast("long"), each(s)) <= s["most"]
        return F.aggregate(known, F.lit(None).cast("double"), lambda a, s: F.when(a.isNotNull(), a).when(fits(s), s["size"]))

    measured = F.transform(F.filter(bullets, lambda b: b != ""), lambda b: F.struct(F.length(b).alias("n"), b.startswith("**").alias("bold")))
    return F.coalesce(let(measured, first), F.lit(float(least)))


def cover_crop(width: Column, height: Column, ratio: Column) -> Column:
    """The centred box of the wanted ratio: struct(left, top, width, height)."""
    wide = width / height > ratio
    w, h = F.when(wide, F.round(height * ratio)).otherwise(width), F.when(wide, height).otherwise(F.round(width / ratio))
    return F.struct(((width - w) / 2).cast("int").alias("left"), ((height - h) / 2).cast("int").alias("top"), w.cast("int").alias("width"), h.cast("int").alias("height"))


def rect_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def padded(x0: Column, y0: Column, x1: Column, y1: Column, amount: float, width: Column, height: Column) -> Column:
    """The box grown on all sides, kept on its page: struct(x0, y0, x1, y1)."""
    return F.struct(
        F.greatest(F.lit(0.0), x0 - amount).alias("x0"), F.greatest(F.lit(0.0), y0 - amount).alias("y0"), F.least(width, x1 + amount).alias("x1"), F.least(height, y1 + amount).alias("y1"),
    )
