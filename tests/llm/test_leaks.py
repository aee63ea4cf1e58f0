"""Leaks that differ from their item by more than the values of its slots."""

from pairforge.llm import decontaminate

ITEM = (
    "a driver carries apples from the old market in Boston to the small harbour and sells 5 of them to every customer "
    "who asks before noon while a patient farmer near Alice counts what remains in the wooden boxes at last"
)


def leaked(spark, item, *texts):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [k in {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} for k in range(len(texts))]


def test_diagonals_are_chained(spark):
    values = ITEM.replace("Boston", "New York").replace("5", "1 000").replace("Alice", "Mary Jane")
    words = ITEM.split()
    inserted = " ".join([*words[:12], "really", *words[12:25], "quite", *words[25:]])
    deleted = " ".join(words[:12] + words[13:25] + words[26:])
    conflict = ITEM.replace("old market", "old market 5").replace("wooden", "5 wooden")
    two_values = conflict.replace("market 5", "market 6").replace("sells 5", "sells 7")
    scattered = " ".join(words[:12]) + " z" * 500 + " " + " ".join(words[12:24])
    assert leaked(spark, ITEM, values, inserted, deleted, "intro. " + inserted + " z" * 50 + " " + inserted, scattered) == [True, True, True, True, False]
    assert leaked(spark, conflict, two_values) == [False]


def test_names_that_begin_sentences(spark):
    item = "Alice has 5 apples today. Bob has 3 pears left. Carol wants 4 plums more. Dave sold 6 figs too."
    renamed = item.replace("Alice", "Emma").replace("Bob", "Frank").replace("Carol", "Grace").replace("Dave", "Henry")
    assert leaked(spark, item, "so " + item, renamed, "intro " + renamed, renamed.replace("has", "had").replace("wants", "took").replace("sold", "hid")) == [True, True, True, False]
    short = "What is the capital of France?"
    assert leaked(spark, short, "Question 7 What is the capital of France", "Question 7 What is the capital of Spain", "asked what is the capital of Spain", "What is the price of bread") == [True, True, True, False]


def test_items_full_of_slots(spark):
    numbers = "12 + 30 - 4 = 38"
    assert leaked(spark, numbers, numbers, "so " + numbers + " holds", "so 7 12 + 30 - 4 = 38", "12 + 31 - 4 = 39") == [True, True, True, False]
    people = "Present were: Alice Smith, Bob Jones, Carol White, Dave Brown, Erin Black, Frank Green"
    assert leaked(spark, people, people, "on that day " + people + " and others", people.replace("Smith", "Gray").replace("White", "Blue").replace("Green", "Reed")) == [True, True, False]
    values = "5 kg 12 m 3 s 40 km 7 h 9 g rest of it all"
    assert leaked(spark, values, "see " + values + " there") == [True]
