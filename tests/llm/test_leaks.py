"""Leaks that an inserted word or a lack of literal words must not hide."""

from weftline.llm import decontaminate

ITEM = (
    "A freight train from Oslo carries timber across the northern valley and stops at 3 stations before it reaches the harbour, "
    "where workers load every single crate onto a ship that leaves for distant markets early next morning"
)


def leaks(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.matched, r.windows, r.reworded) for r in decontaminate.leaks(d, b).collect()}


def test_words_put_in_or_left_out(spark):
    at = ITEM.split().index("harbour,")
    more = ITEM.replace("harbour,", "old harbour,")
    less = " ".join(w for i, w in enumerate(ITEM.split()) if i != at - 1)
    longer = ITEM.replace("3 stations", "3 1/2 stations").replace("Oslo", "Bergen")
    other = " ".join(ITEM.split()[:12]) + " and nothing else of the kind is told in this text"
    got = leaks(spark, [ITEM, f"Before it. {more} After it.", less, longer, other], [ITEM])
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0)} and got[3, 0][2] and not got[1, 0][2]
    assert got[0, 0][0] == got[0, 0][1] and got[1, 0][0] < got[1, 0][1]


def test_slots_agree_over_all_alignments(spark):
    item = "In Oslo the old mayor opens a new bridge over the river every spring and then people of Oslo walk over the same bridge to see the other side of town"
    same = item.replace("every spring", "every wet spring").replace("Oslo", "Bergen")
    odd = same.replace("people of Bergen", "people of Narvik")
    assert set(leaks(spark, [same, odd], [item])) == {(0, 0)}


def test_items_of_few_literal_words(spark):
    item = "Results: 12 kg 15 kg 18 kg 21 kg 27 kg 31 kg 36 kg 44 kg for Oslo Bergen Narvik"
    assert set(leaks(spark, [f"See here. {item} And so on.", item.replace("18", "19").replace("31", "30").replace("15", "16")], [item])) == {(0, 0)}
