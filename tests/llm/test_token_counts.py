import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from selfspan.llm.token_counts import CHUNK, VOCABULARY, CountTree, Encoder, apply_edits, count_tokens, first_version, next_version

piece = st.sampled_from(["a", "'", "l", "ll", " ", "  ", "\n", "1", "23", "é", "don't", "!", "?!", "word ", "\t", "x's", "🙂", "re"])
text = st.lists(piece, max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(text, st.lists(st.tuples(st.integers(-2, 60), st.integers(-2, 60), text), max_size=4))
def test_edited_tree_equals_a_new_count(body, edits):
    encoder = Encoder.load(VOCABULARY)
    tree = CountTree.build(body, encoder)
    assert tree.total == len(encoder.encoding.encode_ordinary(body))
    apply_edits(tree, [{"start": a, "end": b, "new": n} for a, b, n in edits])
    assert tree.total == len(encoder.encoding.encode_ordinary(tree.text))
    assert tree.leaves.sum() == tree.total and tree.starts[-1] == len(tree.text)
    again = CountTree.load(tree.text, lambda: encoder, tree.save())
    assert again.total == tree.total and (again.starts == tree.starts).all() and (again.leaves == tree.leaves).all()
    apply_edits(again, [{"start": a, "end": b, "new": n} for a, b, n in edits])
    assert again.total == len(encoder.encoding.encode_ordinary(again.text))


def test_a_long_text_is_encoded_again_only_near_the_edit():
    encoder = Encoder.load(VOCABULARY)
    tree = CountTree.build("some words and more " * 5000, encoder)
    tree.replace(50_000, 50_003, "other")
    assert tree.encoded < 10
    assert tree.total == len(encoder.encoding.encode_ordinary(tree.text))


def test_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "s", 5), (1, "one two", "s", 5), (None, None, None, None), (2, "", "t", 1)], "doc_id long, text string, source string, tokens int")
    edits = F.array(F.struct(F.lit(4).alias("start"), F.lit(7).alias("end"), F.lit("three four").alias("new")))
    rows = sorted(map(tuple, count_tokens(docs, edits).collect()), key=str)
    assert (1, 2, 2, 1, 3, 3) in rows and rows.count((1, 2, 2, 1, 3, 3)) == 2
    assert [r for r in rows if r[0] is None] == [(None, 0, 0, 1, 2, 2)]
    assert count_tokens(docs.limit(0), edits).count() == 0
    assert count_tokens(docs, F.lit(None)).agg(F.sum("encoded_again")).first()[0] == 0


def test_many_insertions_leave_even_chunks():
    encoder, text = Encoder.load(VOCABULARY), "a few words. " * 20
    tree = CountTree.build(text, encoder)
    for _ in range(30):
        tree.replace(40, 40, "more and more words ")
        tree = CountTree.load(tree.text, lambda: encoder, tree.save())
    assert tree.total == len(encoder.encoding.encode_ordinary(tree.text)) and np.diff(tree.bounds).max() <= CHUNK and tree.width >= len(tree.leaves) // CHUNK


def test_versions_keep_trees_and_spare_what_is_untouched(spark):
    docs = spark.createDataFrame([(1, "one two three", 7), (2, "left as it is, " * 400, 7), (3, None, 7)], "doc_id long, text string, tree int")
    first = first_version(docs)
    at_one = F.when(F.col("row.doc_id") == 1, F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("four five").alias("new"))))
    second = next_version(first, at_one)
    third = {r.row.doc_id: r for r in next_version(second.select("row", "tree"), at_one).collect()}
    assert third[1].row.text == "four fiver five two three" and third[1].row.tree == 7 and third[1].edits == 1 and 0 < third[1].encoded_again < 6
    encoding = Encoder.load(VOCABULARY).encoding
    assert all(r.tree.tokens == len(encoding.encode_ordinary(r.row.text or "")) for r in third.values())
    assert third[2].encoded_again == third[3].encoded_again == 0
    # without a vocabulary nothing can be encoded, and nothing needs to be
    spared = next_version(first, F.when(F.col("row.doc_id") > 9, at_one), "/no/such/file").collect()
    assert [(r.row.doc_id, r.tree.tokens) for r in spared] == [(r.row.doc_id, r.tree.tokens) for r in first.collect()]
    assert next_version(first.limit(0), at_one).count() == 0
