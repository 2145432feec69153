"""Similarity joins and rankings: figures and slides, image candidates, items and texts, near equal rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions import maths
from weftline.functions import text as t


def figure_matches(slides: DataFrame, figures: DataFrame) -> DataFrame:
    """(request_id, pos, figure_no, score): each slide's best figure, each figure used once.

    slides: request_id, pos, title, bullets; figures: request_id, figure_no, caption, section. A
    deck's slides and its figures meet as two arrays in one row, so only they are shuffled, not
    their pairs; the score is coverage plus section bonus. A slide keeps its best figure (the first
    of equals); a figure goes to the slide with the best score (the first of equals) and the loser
    gets no second choice.
    """
    said = F.concat_ws(" ", "title", F.array_join(F.filter("bullets", lambda b: ~b.startswith("**")), " "))
    s = slides.select("request_id", F.struct("pos", t.heading_key(F.col("title")).alias("key"), said.alias("text")).alias("x"))
    f = figures.select("request_id", F.struct("figure_no", t.heading_key(F.col("section")).alias("key"), F.concat_ws(" ", "caption", "section").alias("text")).alias("x"))
    of = lambda rows, name: rows.groupBy("request_id").agg(F.collect_list("x").alias(name))
    out = slides.select("request_id", "pos").schema.add(figures.schema["figure_no"]).add("score", "double")
    # words and scores of whole decks, as by ``text.match_tokens``, ``maths.figure_score`` and ``maths.affinity``
    low = bytes(c | 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c == 45 else 32 for c in range(256))
    stop, roots = {w.encode() for w in lex.MATCH_STOPWORDS}, [math.sqrt(n) for n in range(5)]

    def tokens(x: str) -> set[bytes]:
        """A run of letters, digits and hyphens from its first letter on is a word, if it has three characters."""
        return {w for run in set(x.encode().translate(low).split()) if len(w := run.lstrip(b"-0123456789")) > 2} - stop

    def score(shared: int, of: int, fk: str, sk: str) -> float:
        found = shared / of * roots[min(shared, 4)] if shared and shared / of >= 0.34 and (shared >= 2 or of <= 2) else 0.0
        return found + (0.0 if not fk or not sk else 2.0 if fk == sk else 1.6 if sk.startswith(fk) or fk.startswith(sk) else 0.0)

    def of_deck(slides: list[tuple], figures: list[tuple]) -> list[tuple]:
        """(pos, figure_no, score)"""
        own = [(no, fk, ft, len(ft)) for no, fk, ft in ((no, fk, tokens(x)) for no, fk, x in figures)]
        best: dict[object, tuple] = {}
        for pos, sk, x in slides:
            st, top = tokens(x), (0.0, None)
            for no, fk, ft, of in own:
                shared = len(ft & st)
                if shared or fk:
                    less = -score(shared, of, fk, sk)
                    if less < top[0] or (less == top[0] < 0 and no < top[1]):
                        top = less, no
            if top[0] < 0:
                best[top[1]] = min((top[0], pos), best.get(top[1], (0.0, pos)))
        return [(pos, no, -less) for no, (less, pos) in best.items()]

    def runs(lists: pa.ListArray) -> Iterator[list[tuple]]:
        rows = list(zip(*(x.to_pylist() for x in lists.flatten().flatten()), strict=True))
        ends = list(accumulate(pc.list_value_length(lists).to_pylist(), initial=0))
        return (rows[lo:hi] for lo, hi in pairwise(ends))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of_deck(slides, figures) for slides, figures in zip(runs(batch["slides"]), runs(batch["figures"]), strict=True)]
            deck = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32())
            columns = list(zip(*chain.from_iterable(found), strict=True)) or [(), (), ()]
            kinds = (batch["slides"].type.value_type.field("pos").type, batch["figures"].type.value_type.field("figure_no").type, pa.float64())
            numbers = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["request_id"].take(deck), *numbers], ["request_id", "pos", "figure_no", "score"])

    return of(f, "figures").join(of(s, "slides"), "request_id").select("request_id", "slides", "figures").mapInArrow(matched, out)


def ranked_candidates(candidates: DataFrame, keep: int = 2) -> DataFrame:
    """Best candidate of each (query, provider), then the best ``keep`` of a query; lower scores first, then input order.

    candidates: query, provider, provider_pos, pos, title, width, height, mime, target_ratio.
    """
    usable = F.col("mime").isin("image/jpeg", "image/png", "image/webp") & (F.col("width") >= 640) & (F.col("height") >= 360)
    score = maths.candidate_score(maths.relevance(t.match_tokens(F.col("title")), t.match_tokens(F.col("query"))), F.col("width"), F.col("height"), F.col("target_ratio"))
    c = candidates.where(usable).withColumn("score", score).where("score is not null")
    one = c.withColumn("r", F.row_number().over(Window.partitionBy("query", "provider").orderBy("score", "pos"))).where("r = 1")
    return one.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "provider_pos"))).where(F.col("r") <= keep).drop("r")


def best_text_per_item(items: DataFrame, texts: DataFrame, item: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """(item, doc, shared): for each item the text that shares most distinct words, the least id of equals.

    Texts that hold the item's rarest word give a number of shared words that is reached for sure.
    A text that shares as many of the item's n words holds one of its n - shared + 1 rarest, so only
    those words make candidates, and common words meet no text. Ids identify rows on both sides.
    """
    words = lambda df, key: df.select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("words"))
    i, t = words(items, item).where("size(words) > 0"), words(texts, doc).where("size(words) > 0")
    asked = i.select(item, F.explode("words").alias("w"))
    held = t.select(doc, F.explode("words").alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    rank = F.row_number().over(Window.partitionBy(item).orderBy("n", "w"))
    ranked = asked.join(held.groupBy("w").agg(F.count("*").alias("n")), "w").select(item, "w", rank.alias("r"), F.count("*").over(Window.partitionBy(item)).alias("of"))

    def shared(keys: DataFrame) -> DataFrame:
        pairs = keys.join(held, "w").select(item, doc).distinct()
        return pairs.join(i, item).join(t.withColumnRenamed("words", "theirs"), doc).select(item, doc, F.size(F.array_intersect("words", "theirs")).cast("long").alias("shared"))

    sure = shared(ranked.where("r = 1")).groupBy(item).agg(F.max("shared").alias("sure"))
    best = shared(ranked.join(sure, item).where("r <= of - sure + 1"))
    return best.groupBy(item).agg(F.min_by(F.struct(doc, "shared"), F.struct(-F.col("shared"), F.col(doc))).alias("m")).select(item, "m.*")


def adjacent_similarity(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Similarity of every row's text to the one before in its group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("before", F.lag(text).over(w)).where(F.col("before").isNotNull()).withColumn("similarity", maths.similarity(F.col(text), F.col("before")))


def edit_distance(a: str, b: str) -> int:
    """Least number of inserted, deleted and replaced characters, a column of the table at a time as bits of whole numbers."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole, last, n = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = whole, 0  # where the column rises and falls by one
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = down | (whole & ~(diagonal | up))
        left = up & diagonal
        n += (right >> last & 1) - (left >> last & 1)
        right = right << 1 | 1
        up = whole & (left << 1 | ~(diagonal | right))
        down = whole & right & diagonal
    return n


#: Rows of a group that are compared with all earlier ones in one task.
BLOCK = 32


def earlier_duplicates(rows: DataFrame, group: str, order: str, text: str, least: float = 0.7) -> DataFrame:
    """(group, order): rows whose text is more similar than ``least`` to that of any earlier row of their group, not of the one before alone.

    Lengths are compared first: texts that differ by more than 1 - least in length cannot be so
    similar. A row ends at the first such text, those of the nearest length first. Groups are cut
    into blocks of BLOCK rows, each of which meets the rows before it in a task of its own.
    """
    by = Window.partitionBy(group)
    r = rows.select(group, order, F.lower(text).alias("t")).where(" and ".join(f"`{c}` is not null" for c in (group, order, "t")))
    r = r.withColumn("own", F.floor((F.row_number().over(by.orderBy(order)) - 1) / BLOCK)).withColumn("last", F.max("own").over(by))
    blocks = r.withColumn("block", F.explode(F.sequence("own", "last"))).withColumn("asks", F.col("own") == F.col("block")).drop("own", "last")

    def like(n: int, m: int, distance: int) -> bool:
        return max(0.0, 1 - distance / max(n, m, 1)) > least

    def of_block(block: pa.Table) -> pa.Table:
        places, texts = block[order].to_pylist(), block["t"].to_pylist()
        first: dict[str, object] = {}  # where each text stands first
        for place, x in zip(places, texts, strict=True):
            first[x] = min(place, first.get(x, place))
        found = []
        for i, asks in enumerate(block["asks"].to_pylist()):
            n = len(texts[i])
            near = [x for x, place in first.items() if asks and place < places[i] and like(n, len(x), abs(n - len(x)))]
            found.append(any(like(n, len(x), 0 if x == texts[i] else edit_distance(texts[i], x)) for x in sorted(near, key=lambda x: (x != texts[i], abs(n - len(x))))))
        return block.filter(pa.array(found)).select([group, order])

    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism
    out = blocks.select(group, order).schema
    return blocks.repartition(tasks, group, "block").groupBy(group, "block").applyInArrow(of_block, out).distinct()


def top_slides(affinities: DataFrame, k: Column | int) -> DataFrame:
    """The k slides of a request with the largest affinity, the first of equals."""
    w = Window.partitionBy("request_id").orderBy(F.desc("affinity"), "pos")
    return affinities.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def at_most_twice(images: DataFrame) -> DataFrame:
    """Images whose content was used less than twice before in reading order: sha1, page, y0, pos."""
    w = Window.partitionBy("doc_id", "sha1").orderBy("page", "y0", "pos")
    return images.withColumn("use", F.row_number().over(w)).where("use <= 2")
