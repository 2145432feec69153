"""Prompts and what answers them: templates filled from data, providers asked in waves, and text wrapped by glyph widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.plans.inputs import kept

#: A placeholder of a template: a name in braces.
PLACEHOLDER = "\\{([A-Za-z_][A-Za-z0-9_]*)\\}"


def filled(template: Column, values: Column) -> Column:
    """(text, missing): a template with its placeholders replaced from a map, and the distinct names that the map lacks, in order.

    A missing name stays as it is written; a null value is empty. What is put in is not searched for
    placeholders again, since the text between them is cut first and joined with the values.
    """
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    between = F.split(template, PLACEHOLDER)
    value = lambda n: F.when(F.map_contains_key(values, n), F.coalesce(F.element_at(values, n), F.lit(""))).otherwise(F.concat(F.lit("{"), n, F.lit("}")))
    pieces = F.transform(between, lambda p, i: F.concat(p, F.when(i < F.size(names), value(F.get(names, i))).otherwise("")))
    return F.struct(F.array_join(pieces, "").alias("text"), F.array_distinct(F.filter(names, lambda n: ~F.map_contains_key(values, n))).alias("missing"))


def answered_in_waves(prompts: DataFrame, responses: DataFrame, chain: list[str]) -> DataFrame:
    """(prompt_id, answer, provider, tried): each prompt's answer by the first provider of the chain that gives one.

    prompts: prompt_id (unique), day, turn (order of the calls of a day); responses, as recorded:
    provider, prompt_id, body, quota (whether the body tells that the quota of the day is used up).
    A wave asks one provider for what all before it left open: from the day's first quota error on,
    it is not asked again that day. Answers are written, and only what is left goes on, by an
    anti-join on them. Null and blank bodies are no answers. ``tried`` names the providers that were
    asked or latched before; a prompt that none answers has a null answer and provider.
    """
    left, answers = prompts.select("prompt_id", "day", "turn"), None
    for at, provider in enumerate(chain):
        own = responses.where(F.col("provider") == provider).select("prompt_id", "body", F.coalesce("quota", F.lit(False)).alias("quota"))
        asked = left.join(own, "prompt_id")
        latch = asked.where("quota").groupBy(F.col("day").alias("_day")).agg(F.min("turn").alias("latch"))
        open_ = asked.join(latch, F.col("day").eqNullSafe(F.col("_day")), "left").where(F.col("latch").isNull() | (F.col("turn") < F.col("latch")))
        got = open_.where("not quota and trim(body) <> ''").select("prompt_id", F.col("body").alias("answer"), F.lit(provider).alias("provider"), F.lit(at).alias("before"))
        got = kept(got, "answers")
        answers = got if answers is None else answers.unionByName(got)
        left = kept(left.join(got, "prompt_id", "left_anti"), "open")
        if left.isEmpty():
            break
    if answers is None:
        answers = left.limit(0).select("prompt_id", F.lit("").alias("answer"), F.lit("").alias("provider"), F.lit(0).alias("before"))
    names = F.array(*map(F.lit, chain)).cast("array<string>")
    out = prompts.select("prompt_id").join(answers, "prompt_id", "left")
    return out.select("prompt_id", "answer", "provider", F.slice(names, F.lit(1), F.coalesce("before", F.lit(len(chain)))).alias("tried"))


def wrapped(x: Column, widths: Column, most: Column | float, space: Column | float, other: Column | float) -> Column:
    """Lines of words that are at most ``most`` wide, as many words in each as fit; a wider word is a line of its own.

    widths: a map from a character to its width; ``other`` is the width of characters that it lacks,
    ``space`` that of a space. Null has no lines. A fold over the words; the width of each is
    computed once.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    most, space, other = map(lit, (most, space, other))
    wide = lambda w: F.aggregate(F.split(w, ""), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.coalesce(F.element_at(widths, c), other)))
    words = F.transform(F.filter(F.split(t.squeeze(x), " "), lambda w: w != ""), lambda w: F.struct(w.alias("word"), wide(w).alias("width")))
    state = lambda done, line, width: F.struct(done.alias("done"), line.alias("line"), width.alias("width"))

    def step(s: Column, w: Column) -> Column:
        both = s["width"] + space + w["width"]
        return (
            F.when(s["line"] == "", state(s["done"], w["word"], w["width"])).when(both <= most, state(s["done"], F.concat(s["line"], F.lit(" "), w["word"]), both))
            .otherwise(state(F.concat(s["done"], F.array(s["line"])), w["word"], w["width"]))
        )

    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(0.0))
    return F.aggregate(words, start, step, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))
