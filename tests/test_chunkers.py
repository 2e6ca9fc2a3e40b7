import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.operators import chunkers as ch


def ranges(chunks):
    return [c[:2] for c in chunks]


def test_goldens():
    assert ranges(ch.markdown("# A\nx\ny\n# B\nx\ny\n# C\nx", 20, 0)) == [(1, 3), (4, 6), (7, 8)]
    assert ranges(ch.json_chunks('{\n  "a": 1,\n  "b": 2,\n  "c": 3\n}')) == [(2, 2), (3, 3), (4, 5)]
    assert ranges(ch.json_chunks('[\n  {\n    "a": 1\n  },\n  {\n    "a": 2\n  },\n  {\n    "a": 3\n  }\n]')) == [(2, 4), (5, 7), (8, 10)]
    assert ranges(ch.json_chunks("{}")) == ranges(ch.json_chunks("not json")) == [(1, 1)]
    assert ch.json_chunks(' {"a": 1, "b": {"c": 2}} ') == [(1, 1, ' {"a": 1, "b": {"c": 2}} ')]
    assert ranges(ch.jsonl('{"a":1}\n{"a":2}\n{"a":3}')) == [(1, 1), (2, 2), (3, 3)]
    assert ranges(ch.jsonl('{"a":1}\n\n{"a":3}')) == [(1, 1), (3, 3)]
    assert ranges(ch.yaml("a: 1\nb: 2\nc:\n  d: 3")) == [(1, 1), (2, 2), (3, 4)]
    assert ranges(ch.yaml("doc1: 1\n---\ndoc2: 2\n---\ndoc3: 3")) == [(2, 3), (4, 5)]
    assert ch.whole(" \n ") == []


def test_kept_oddities():
    assert ch.json_chunks('{"a": 1,\n"b": 2,\n"c": 3}') == [(2, 2, '"b": 2'), (3, 3, '"c": 3}')]  # a first key beside the brace is lost
    assert ch.yaml("lost\na: 1\nb: 2") == [(2, 2, "a: 1"), (3, 3, "b: 2")]
    assert ch.json_chunks("[1, 2, {\n}]") == [(1, 2, "[1, 2, {\n}]")]


def test_long_lines():
    assert [len(c[2]) for c in ch.markdown("x" * 1000, 64, 8)] == [256] * 4 + [232, 40]
    assert [c[:2] for c in ch.split_oversized([(3, 5, "a\n" + "b" * 300 + "\nc")], 256)] == [(3, 3), (4, 4), (4, 4), (5, 5)]
    assert len(ch.chunk_file("z" * 5000, "a.md", 64)) < len(ch.markdown("z" * 5000, 64, 8))  # equal slices have one id
    assert ch.units("a😀") == 3 and ch.unit_slice("a😀b", 0, 3) == "a😀"
    for size in (16, 63):
        with pytest.raises(ValueError):
            ch.chunk_file("x", "a.md", size)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["", "# h", "x" * 30, "word " * 20, "y" * 500]), min_size=1, max_size=30), st.sampled_from([64, 100]), st.sampled_from([0, 8]))
def test_markdown_covers_every_line(lines, tokens, overlap):
    text = "\n".join(lines)
    chunks = ch.markdown(text, tokens, overlap)
    seen = {n for a, b, _ in chunks for n in range(a, b + 1)}
    assert seen >= {i for i, x in enumerate(lines, 1) if len(x) < 4 * tokens}
    for a, b, t in chunks:
        if len(lines[a - 1]) < 4 * tokens:
            assert t == "\n".join(lines[a - 1 : b])
        assert not any(x.startswith("# ") for x in lines[a:b])


def test_over_dataframes(spark):
    files = spark.createDataFrame([("a.md", "memory", "# A\nx\n# B\ny"), ("b.jsonl", "memory", "1\n\n2 "), ("c.json", "sessions", '{\n"a": 1,\n"b": 2\n}'), ("d.md", "memory", None)], "path string, source string, text string")
    rows = {(r["path"], r["start_line"], r["end_line"]): r for r in ch.chunked(files).collect()}
    assert set(rows) == {("a.md", 1, 2), ("a.md", 3, 4), ("b.jsonl", 1, 1), ("b.jsonl", 3, 3), ("c.json", 1, 4)}
    native = {r["id"] for r in ch.jsonl_chunked(files.where("path = 'b.jsonl'")).collect()}
    assert native == {r["id"] for k, r in rows.items() if k[0] == "b.jsonl"}
