from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.functions.tokenizer import tokenize
from memloom.operators import facts


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*map(F.col, names))).first()[0]


def test_hash_and_lengths(spark):
    assert one(spark, tx.content_hash, "hello world") == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert one(spark, tx.utf16_length, "a😀b") == 4
    assert one(spark, tx.trim, " ﻿ x y 　\n") == "x y"
    assert one(spark, tx.normalized, "  A \t b\nC ") == "a b c"


def test_like(spark):
    for text, query, want in (("Ab%C", "b%c", True), ("É", "é", False), ("a\\b", "A\\B", True), ("axc", "a_c", False)):
        assert one(spark, tx.like_contains, text, query) is want


def test_tokens(spark):
    assert one(spark, tx.tokens, "Élan foo_bar Łódź straße Ǘber ø") == ["elan", "foo", "bar", "łodz", "straße", "ǘber", "ø"]
    assert one(spark, tx.tokens, "我爱北京x") == ["我爱", "爱北", "北京", "x"]
    assert one(spark, tx.tokens, "一 x") == ["一", "x"]
    assert one(spark, tx.query_tokens, "foo_bar Élan") == [["foo", "bar"], ["lan"]]
    assert one(spark, tx.query_tokens, "Привет") == []


def test_entries(spark):
    cases = {
        "- use tabs — 2024-01-02 03:04:05 UTC": "use tabs",
        "- a fact [ref:memory/evidence/ab.md] _(source: chat)_ — 2024-01-02 03:04:05 UTC": "a fact",
        "- plain": "plain",
        "* no": None,
        "- keeps [x] _y_": "keeps [x] _y_",
    }
    for line, want in cases.items():
        assert one(spark, tx.entry_fact, line) == want
        assert facts.fact_of(line) == want
    assert one(spark, tx.entry_ref, "- a [ref:m/e.md] — 2024") == "m/e.md"
    assert one(spark, lambda a, b: tx.compact_snippet(a, b), "- x _(source: s)_\n\n\n\n- y — 2024-01-01 ", "memory") == "x\n\n- y — 2024-01-01".replace("- y — 2024-01-01", "y")
    assert one(spark, lambda a, b: tx.compact_snippet(a, b), " - x _(source: s)_ ", "sessions") == "- x _(source: s)_"


def test_words_and_ranges(spark):
    assert sorted(one(spark, tx.content_words, "Use a TAB-size, of 4; use 北京!")) == ["of", "tab-size", "use", "北京"]
    assert facts.content_words("Use a TAB-size, of 4; use 北京!") == {"of", "tab-size", "use", "北京"}
    assert one(spark, lambda a, b: tx.overlap(tx.content_words(a), tx.content_words(b)), "red green blue", "green blue sky now") == 2 / 3
    text = "a\nb\nc\nd"
    assert [one(spark, lambda t, f=f, n=n: tx.line_range(t, f, n), text) for f, n in ((2, 2), (0, 0), (3, None), (None, 1), (9, 1))] == ["b\nc", text, "c\nd", "a", ""]
    assert one(spark, tx.slug, "My Notes!") == "my-notes-"
    assert one(spark, tx.extension, "a.b/C.MD") == ".md"


def test_both_tokenizers_agree(spark):
    for t in ("", "Plain ASCII_text 1-2", "Élan Łódź Ǘber straße ø", "我爱北京x 一 漢字", "e\u0301a x²½ Ⅷ", "Привет мир καλημέρα", "\ue000a"):
        assert tokenize(t) == one(spark, tx.tokens, t), t
