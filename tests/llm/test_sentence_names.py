"""Re-parameterised questions whose names start sentences, and whose numbers are words."""

from gridloom.llm import decontaminate

ITEMS = [
    (1, "Natalia sold 48 clips to her friends in April. Natalia then sold half as many clips in May. How many clips did Natalia sell altogether?"),
    (2, "Anna buys 12 apples and 5 pears. Anna gives 3 apples to Ben. How many pieces of fruit does Anna have left after that?"),
    (3, "A baker bakes twelve loaves of bread and sells five of them before noon. Seven more are sold later."),
]
DOCS = [
    (1, "Marina sold 52 clips to her friends in June. Marina then sold half as many clips in July. How many clips did Marina sell altogether?"),
    (2, "Maria buys 15 apples and 7 pears. Maria gives 4 apples to Tom. How many pieces of fruit does Maria have left after that?"),
    (3, "A baker bakes 30 loaves of bread and sells six of them before noon. Nine more are sold later."),
    (4, ITEMS[0][1]),
    # names that are not swapped alike
    (5, "Marina sold 52 clips to her friends in June. Olga then sold half as many clips in July. How many clips did Petra sell altogether?"),
]


def test_sentence_starts_and_number_words(spark):
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(frame(DOCS, "doc_id"), frame(ITEMS, "item_id")).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 1)}
    assert got[4, 1].verbatim and got[4, 1].coverage == 1 and not got[1, 1].verbatim
