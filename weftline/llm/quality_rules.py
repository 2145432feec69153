"""Quality rules: counting rules, and Jensen-Shannon distance to language references. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written

#: The symbols counted, and what separates words.
SYMBOLS = "#*$%&|<>"
SPACE = "[ \\t-\\r]+"

#: Common words of each language whose shares are compared; all other words are one more class.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "as", "with", "on", "this", "are", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "ein", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "dans", "qui"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "con", "no"],
}
#: The character classes, as what is taken out of a text one after the other; the rest is one more class.
CLASSES = (("lower", "[a-z]+"), ("space", "[ \\t-\\r]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("point", "[.,;:!?'\"()-]+"), ("symbol", "[#*$%&|<>@=+~^/_{}\\[\\]]+"))

#: Parameters: documents with fewer words are not compared, nor those of a language of which fewer documents pass the
#: counting rules (they would be their own reference), and the largest distances that pass.
MIN_WORDS = 50
MIN_DOCS = 20
MAX_CHARS = 0.22
MAX_WORDS = 0.3


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the array of words.

    Windows are keyed by a 64-bit hash; sorting (hash, position) puts equal ones side by side; the
    repeated positions in order then cover min(3, gap to the next) words each.
    """

    def marked(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])

    def of(w: Column) -> Column:
        two = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b))
        three = F.slice(F.zip_with(two, F.slice(w, F.lit(3), F.size(w)), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.size(w) - 2)
        some = let(three, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), marked), covered)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(some)

    return let(words, of)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """The counts of every document, its histograms (arrays of long) and its language, unknown ones as 'other'."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    langs = F.when(F.col(lang_col).isin(*COMMON), F.col(lang_col)).otherwise("other")
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), langs.alias("lang"), *row)
    some = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    names = ["row"] if carry else []
    split = base.select("doc_id", "lang", "text", *names, some.alias("words"), lines.alias("lines"))
    common = F.coalesce(*(F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()), F.array(*map(F.lit, COMMON["en"])))
    lengths = let(F.regexp_replace("text", CLASSES[0][1], ""), lambda x1: let(F.regexp_replace(x1, CLASSES[1][1], ""), lambda x2: _tail(x1, x2)))
    every = sorted({w for v in COMMON.values() for w in v})
    hits = F.filter("words", lambda w: w.isin(*every))
    return (
        split.select("*", lengths.alias("lengths"), repeated_words(F.col("words")).alias("n_repeat_words"), hits.alias("hits"), common.alias("list"))
        .select(
            "doc_id",
            "lang",
            F.size("words").cast("long").alias("n_words"),
            (F.length("text") - (F.col("lengths")[0] - F.col("lengths")[1])).cast("long").alias("word_chars"),
            (F.col("lengths")[1] - F.col("lengths")[len(CLASSES)]).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            F.length("text").cast("long").alias("n_chars"),
            F.array((F.length("text") - F.col("lengths")[0]).cast("long"), *((F.col("lengths")[i] - F.col("lengths")[i + 1]).cast("long") for i in range(len(CLASSES) - 1))).alias("chars"),
            F.transform("list", lambda x: (F.size("hits") - F.size(F.array_remove("hits", x))).cast("long")).alias("common"),
            *names,
        )
    )


def _tail(x1: Column, x2: Column) -> Column:
    """Lengths left after each class, and last what is left of x2 without the counted symbols."""
    rest, out = x2, [F.length(x1), F.length(x2)]
    for _, gone in CLASSES[2:]:
        rest = F.regexp_replace(rest, gone, "")
        out.append(F.length(rest))
    return F.array(*out, F.length(F.regexp_replace(x2, "[#*$%&|<>]+", "")))


def shares(counts: Column, total: Column) -> Column:
    """The counts and what is left of the total, as shares."""
    rest = F.greatest(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return F.transform(F.concat(counts, F.array(rest)), lambda x: x / F.greatest(total, F.lit(1).cast("long")))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(feats: DataFrame) -> DataFrame:
    """For each language (five at most) with MIN_DOCS documents that pass the counting rules, the pooled shares over all of them."""
    k, m = len(CLASSES), len(COMMON["en"])
    pooled = feats.where(~base_failed()).groupBy("lang").agg(
        F.array(*(F.sum(F.col("chars")[i]) for i in range(k))).alias("chars"),
        F.array(*(F.sum(F.col("common")[i]) for i in range(m))).alias("common"),
        F.sum("n_chars").alias("n_chars"),
        F.sum("n_words").alias("n_words"),
        F.count("*").alias("docs"),
    )
    return pooled.where(F.col("docs") >= MIN_DOCS).select("lang", shares(F.col("chars"), F.col("n_chars")).alias("ref_chars"), shares(F.col("common"), F.col("n_words")).alias("ref_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", refs: DataFrame | None = None, carry: bool = False) -> DataFrame:
    """One row for each row of docs: counts, distances to the language's reference, and the verdict ``kept``.

    With ``carry`` the row itself comes along in a struct ``row``.
    A null text is empty, has no words and fails. Null and unknown languages share the reference
    'other'. A distance is null, and never rejects, below MIN_WORDS words or where there is no
    reference (fewer than MIN_DOCS documents of the language pass the counting rules). Repeated rows give repeated
    results; other columns are ignored. The references have five rows at most, one for each key of
    COMMON and 'other', so broadcasting them is safe at any size.
    """
    feats = written(features(docs, id_col, text_col, lang_col, carry), "features")
    refs = references(feats) if refs is None else refs
    both = feats.join(F.broadcast(refs), "lang", "left")
    enough = F.col("n_words") >= MIN_WORDS
    out = both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        F.when(enough, js_distance(shares(F.col("chars"), F.col("n_chars")), F.col("ref_chars"))).alias("js_chars"),
        F.when(enough, js_distance(shares(F.col("common"), F.col("n_words")), F.col("ref_words"))).alias("js_words"),
        *(["row"] if carry else []),
    )
    passes = (F.coalesce("js_chars", F.lit(0.0)) <= MAX_CHARS) & (F.coalesce("js_words", F.lit(0.0)) <= MAX_WORDS)
    return out.withColumn("kept", ~F.col("base_failed") & passes)
