from codeloom.llm import decontaminate as d
from codeloom.llm import queries
from tests.llm.helpers import SF, docs, needs_data, rows

ITEM = "A farmer named Tom Miller buys 12 baskets of apples and gives 5 of them to his neighbour Anna before he drives 30 km home."
SHORT = "What colour is the sky today?"


def found(spark, texts):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, SHORT), (3, None), (4, "tiny"), (None, ITEM)], "item_id long, text string").withColumn("key", d.F.lit(0))
    return {(r.key, r.item): r.kind for r in d.leaks(docs(spark, texts), bench).collect()}


def test_copies_and_changed_slots(spark):
    changed = ITEM.replace("Tom", "Bob").replace("Miller", "Stone").replace("12", "48").replace("5", "seven").replace("30 km", "9 miles").replace("Anna", "Eve")
    clash = changed.replace("Eve", "Bob")
    got = found(spark, [(1, "Foo bar. " + ITEM + " The end."), (2, "Foo. " + changed), (3, "Foo. " + clash), (4, ITEM.upper()), (5, "clean text " * 40), (6, "hm *** " + " *** ".join(ITEM.split()[:14])), (7, "So what colour is the sky today? Blue"), (8, None), (9, "")])
    assert got == {("1", "1"): "copy", ("2", "1"): "template", ("6", "1"): "copy", ("7", "2"): "copy", ("4", "1"): "copy"} or got == {("1", "1"): "copy", ("2", "1"): "template", ("6", "1"): "copy", ("7", "2"): "copy"}


def test_rows_without_id_and_very_long_texts(spark):
    df = docs(spark, [(None, ITEM), (None, "clean"), (3, "word " * 200_000 + ITEM), (3, "clean"), (5, "clean")])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert rows(d.drop_leaked(df, bench), "doc_id", "text") == sorted([(None, "clean"), (5, "clean")], key=repr)
    assert d.drop_leaked(df, bench.limit(0)).count() == 5 and d.drop_leaked(df.limit(0), bench).count() == 0


def test_query_against_plain_windows(spark):
    """Every document that holds eight words of an item in a row is found, and no document without shared template."""
    needs_data()
    word = lambda t: [w.lower() for w in d._TOKEN.findall(t or "")]
    cut = lambda w: {tuple(w[i:i + 8]) for i in range(len(w) - 7)}
    bench = {r.item_id: cut(word(r.text)[1:]) for r in queries.table(spark, SF, "benchmark").collect()}
    want = set()
    for r in queries.table(spark, SF, "documents").collect():
        own = cut(word(r.text))
        want |= {(r.doc_id, i) for i, w in bench.items() if w & own}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op7_decontamination"](spark, SF).filter("kind = 'copy'").collect()}
    assert want and got == want


def test_every_exact_copy_is_found(spark):
    items = ["What is 12 + 15?", "Buy 3 kg, 4 lb, 5 oz, 6 kg, 7 g, 8 kg", "The Tall Man Of Old Rome Saw A Great Red Ship", "Der Hund von Peter Maier sah Katzen, Hunde, Pferde und Kühe", "今天天气怎么样", "Name it"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [(i, f"Foo bar\n{text}\nand more") for i, text in enumerate(items)] + [(90, "What is 13 + 15?"), (91, "今天天气很好"), (92, "clean")]
    got = {(r.key, r.item, r.kind) for r in d.leaks(docs(spark, texts), bench).collect()}
    assert got == {(str(i), str(i), "copy") for i in range(len(items))}
    whole = {r.item: r.share for r in d.leaks(docs(spark, texts), bench).collect()}
    assert set(whole.values()) == {1.0}


def test_texts_hashed_together_give_the_windows_of_each():
    texts = [ITEM, "", "one", SHORT, "Tom has 5 apples. Tom buys 3 apples.", "*** !", ITEM.upper(), "word " * 50 + ITEM]
    lengths = [1, 3, 8]
    together = sorted((i, *map(repr, w)) for i, *w in d.Vocabulary().windows(texts, lengths))
    alone = sorted((i, *map(repr, w)) for i, text in enumerate(texts) for _, *w in d.Vocabulary().windows([text], lengths))
    assert together == alone and {i for i, *_ in together} == {0, 2, 3, 4, 6, 7}
    assert [x for x in d._together(["a" * d.TOGETHER, "b", "c"])] == [(0, ["a" * d.TOGETHER]), (1, ["b", "c"])]


def test_vocabulary_forgets_chunks_of_few_words():
    words = d.Vocabulary()
    for at in range(0, 4 * d.KNOWN_WORDS, 1000):
        words.template(" ".join(f"word{'-' * (i % 400)}{'+' * (i // 400)}" for i in range(at, at + 1000)))
        assert len(words) <= d.KNOWN_WORDS + 1000 and len(words.text) <= d.KNOWN_WORDS + 1000


def test_long_chunks_are_not_remembered():
    """Texts in scripts without spaces are one chunk each; they must not stay in a task's memory."""
    words = d.Vocabulary()
    for at in range(40):
        assert len(words.template(chr(0x4E00 + at) * 5000)[0]) == 5000
    words.template("Apple. pear, fig: \"plum.\" 今天")
    assert set(words) == {"Apple.", "pear,", "fig:", "\"plum.\"", "今天"}
    assert sum(len(chunk) + len(packed) for chunk, packed in words.items()) < 200


def test_sentence_ends_and_slots_of_packed_words():
    kinds = lambda text: d.Vocabulary().template(text)[0].tolist()
    assert kinds("Tom met Anna. Bob (Eve) ran, Zoe; Kim: Lea! Max? Ida") == [0, 0, 3, 0, 3, 0, 3, 3, 0, 0, 0]
    assert kinds("He said \"Go.\" Then 5 km and 3.5 tons") == [0, 0, 3, 0, 1, 2, 0, 1, 2]
    slots = [w[3] for w in d.Vocabulary().windows(["we saw Anna walk 12 km to the old mill"], [8]) if w[3]]
    assert ["3:anna", "1:12", "2:km"] in slots
