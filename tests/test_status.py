from memloom.operators import status as st


def test_warnings(spark):
    files = spark.createDataFrame([(f"{i}.md", "memory") for i in range(51)], "path string, source string")
    chunks = spark.createDataFrame([(f"a{i}", f"{i}.md", "same" if i < 2 else f"h{i}") for i in range(51)] + [(f"b{i}", "big.md", f"x{i}") for i in range(501)], "id string, path string, hash string")
    got = st.warnings(files, chunks)
    assert got == [st.MANY_FILES_TEXT.format(51), st.DUPLICATES_TEXT.format(1, "0.md,1.md"), st.LARGE_FILES_TEXT.format("big.md (501 chunks)")]
    assert st.warnings(files.limit(50), chunks.where("path = '3.md'")) == []


def test_counts(spark):
    files = spark.createDataFrame([("a", "memory"), ("b", "sessions"), ("c", "sessions")], "path string, source string")
    chunks = spark.createDataFrame([("1", "a", "h"), ("2", "b", "h")], "id string, path string, hash string")
    vectors = spark.createDataFrame([("1",), ("9",)], "id string")
    got = st.counts(files, chunks, vectors).first().asDict()
    assert got == {"files": 3, "memory_files": 1, "session_files": 2, "chunks": 2, "embedded_chunks": 1, "embedding_cache": 0}
    assert st.counts(files, chunks).first()["embedded_chunks"] == 0


def test_all_large_files_are_named(spark):
    chunks = spark.range(130 * 501).selectExpr("concat('f', id % 130) as path", "cast(id as string) as hash")
    (warning,) = st.warnings(chunks.where("false"), chunks)
    assert warning.count("(501 chunks)") == 130
