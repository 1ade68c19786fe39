"""Benchmark items that stand in a document word for word, whatever stands before them and however they are made."""

from loomgraph.llm import decontaminate


def found(spark, items, docs):
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_windows, r.coverage, r.same_slots) for r in decontaminate.contaminated(d, b).collect()}


def test_first_word_after_a_lower_case_word(spark):
    item = "What is the capital city of France today"
    got = found(spark, [item], [f"see the question {item} and so on", f"after 5 {item}", f"Start. {item}"])
    assert set(got) == {(0, 0), (1, 0), (2, 0)} and all(v == (1, 1.0, True) for v in got.values())


def test_first_word_that_may_be_a_unit(spark):
    got = found(spark, ["m is the letter that comes before n here"], ["the value 5 m is the letter that comes before n here"])
    assert set(got) == {(0, 0)}


def test_templates_keep_their_names_inside(spark):
    item = "yesterday the old farmer Anna sold ripe apples to the town market and went home again"
    got = found(spark, [item], [item, item.replace("Anna", "Berta"), item[item.index("Anna") :]])
    assert got[0, 0][1] == got[1, 0][1] == 1.0 and (2, 0) in got


def test_slot_heavy_and_short_items_by_exact_values(spark):
    items = ["What is 17 + 25 * 3 - 12 / 4 + 8?", "Name the river", "Compute 3.5 * 2.25 + 9 / 4 - 1.5"]
    docs = [f"now then {items[0]} they ask", items[0].replace("25", "26"), f"he said {items[1]} please", "Name the lake", f"so {items[2]} then", items[2].replace("2.25", "2.75")]
    assert set(found(spark, items, docs)) == {(0, 0), (2, 1), (4, 2)}
