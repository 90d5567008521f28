import pytest

from screenlens.llm.decontaminate import Canonical, Tokens, _Vocabulary, find_leaks, without_leaks

ITEMS = [
    (1, "A train travels 120 km in 2 hours. How far does it go in 7 hours at the same speed as before?"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank."),
    (3, "too short"),
    (4, None),
    (5, "The quick brown fox jumps over the lazy dog near the river bank!"),
    (6, "If Anna gives Bob 3 apples and Bob gives Anna 5 pears, how many more does Anna own than Bob?"),
    (7, ""),
]
FILL = "Some words of no importance stand here, and others follow them. "


def found(spark, docs, pairs, items=ITEMS):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hash string")
    return {(r.doc_id, r.item_id) for r in find_leaks(docs(pairs), benchmark).collect()}


def test_literal_and_new_values(spark, docs):
    train = "A train travels {} km in {} hours. How far does it go in {} hours at the same speed as before?"
    anna = "If {0} gives {1} 3 apples and {1} gives {0} 5 pears, how many more does {0} own than {1}?"
    pairs = [
        (10, FILL + ITEMS[0][1] + FILL),
        (11, FILL + train.format(90, 4, 11) + FILL),
        (12, FILL + "a TRAIN travels 95 miles in 3 hours; how far does it go in 9 hours at the same speed as before" + FILL),
        (13, FILL * 3),
        (14, FILL + ITEMS[1][1].upper() + FILL),
        (15, FILL + "the quick brown fox jumps over a lazy dog near the river bank" + FILL),
        (16, "the quick brown fox"),
        (17, None),
        (18, ""),
        (19, FILL + anna.format("Maria", "Joe Smith") + FILL),
        (20, FILL + "If Maria gives Joe 3 apples and Eve gives Paul 5 pears, how many more does Kim own than Lee?"),
        (21, (FILL + ITEMS[1][1] + " ") * 300),
        (None, FILL + ITEMS[1][1]),
        (14, FILL + ITEMS[1][1].upper() + FILL),
    ]
    got = found(spark, docs, pairs)
    assert got == {(10, 1), (11, 1), (12, 1), (14, 2), (15, 2), (19, 6), (21, 2), (None, 2)}


@pytest.mark.parametrize(
    "item",
    [
        "Compute 12 + 7 - 3 + 44 and then subtract 5 from 9.",
        "What is 17 * 23?",
        "1, 2, 3, 5, 8, 13 and 21",
        "Define entropy",
        "一列火车两小时行驶一百二十公里",
        "鱼和熊掌",
    ],
)
def test_items_poor_in_words_or_short(spark, docs, item):
    glued = not item.isascii()
    copy = "前面" + item + "后面的话" if glued else FILL + item + " " + FILL
    other = item.translate(str.maketrans("一二三鱼", "九八七鸟")) if glued else item.replace("Define", "Explain")
    pairs = [(10, copy), (11, FILL * 2), (12, "我们今天不说这件事"), (13, copy.upper()), (14, " ".join(item.split()[:-2])), (15, None)]
    if not any(c.isdigit() for c in item) and len(item) < 20 and not item.startswith("一"):
        pairs.append((16, FILL + other + FILL))
    assert found(spark, docs, pairs, [(1, item), (2, None), (3, "?!")]) == {(10, 1), (13, 1)}


def test_values_count_where_words_do_not(spark, docs):
    pairs = [(10, FILL + "What is 17 * 24?"), (11, FILL + "Compute 1 + 2 - 3 + 4 and then subtract 6 from 8." + FILL)]
    items = [(1, "What is 17 * 23?"), (2, "Compute 12 + 7 - 3 + 44 and then subtract 5 from 9.")]
    assert found(spark, docs, pairs, items) == {(11, 2)}


def test_names_that_begin_sentences(spark, docs):
    anna = "{0} has 5 apples. {0} gives 2 to {1}. How many apples does {0} have left?"
    once = "{0} has 5 apples in a basket. She gives 2 of them to {1}. How many apples are left in the basket?"
    items = [(1, anna.format("Anna", "Ben")), (2, once.format("Anna", "Ben"))]
    mixed = "Mary has 7 apples. Kim gives 3 to Tom. How many apples does Lee have left?"
    pairs = [
        (10, FILL + anna.replace("5", "7").replace("2", "3").format("Mary", "Tom")),
        (11, FILL + once.replace("5", "8").format("Joe Smith", "Tom") + " " + FILL),
        (12, FILL + mixed),
        (13, FILL * 2),
    ]
    assert found(spark, docs, pairs, items) == {(10, 1), (11, 2)}


def test_values_of_equal_slots_must_agree(spark, docs):
    items = [(1, "there were 5 birds on the fence and 5 birds in the tree when 5 birds flew off together again")]
    same = "there were 8 birds on the fence and 8 birds in the tree when 8 birds flew off together again"
    other = "there were 8 birds on the fence and 9 birds in the tree when 7 birds flew off together again"
    assert found(spark, docs, [(1, same), (2, other)], items) == {(1, 1)}


@pytest.mark.parametrize("n", [40, 3000])
def test_copies_of_an_item_are_one_template(spark, docs, n):
    items = [(i, f"What is the sum of {i} and {2 * i} plus the size of the old garden?") for i in range(10, 10 + n)]
    got = find_leaks(
        docs([(1, "what is the sum of 7 and 9 plus the size of the old garden")]),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert [(r.doc_id, r.item_id, r.n_items) for r in got] == [(1, 10, n)]


def test_empty_tables(spark, docs):
    assert found(spark, docs, [(1, ITEMS[1][1])], [(None, None)]) == set()
    assert found(spark, docs, []) == set()
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = without_leaks(docs([(1, ITEMS[1][1]), (2, "clean"), (None, "clean"), (3, None)]), benchmark)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3]
    assert "hash" in kept.columns


def test_kinds():
    text = "He paid 5 kg of gold to John Smith. Then 50% off! m is a word."
    tokens = Canonical(Tokens(text, _Vocabulary()), names=True)
    values = [tokens.value(i) for i in range(len(tokens))]
    assert [v for v in values if v] == ["3:5", "4:kg", "5:john smith", "3:50", "4:%"]
    assert len(tokens) == 16
    assert len(Canonical(Tokens(text, _Vocabulary()), names=False)) == 17


def test_query_finds_every_planted_item(spark):
    """Items that stand in a document word for word, found by plain search."""
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {r.doc_id for r in docs.collect() if any(t in (r.text or "") for t in items.values())}
    assert want and want <= got and len(got) <= len(want) + 3
