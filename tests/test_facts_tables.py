"""Facts as tables: long lines and texts cost what their length costs, and a small file is all cores' work."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators import facts as fc
from memloom.plans import catalogue
from tests.test_catalogue import DATA, pytestmark as needs_tables

PIECES = [" ", "  ", "\t", "　", "\n", "\r", " ", "x", "é", "😀", "[ref:", "]", " [ref:a]", "_(source:", ")_", " _(source: chat)_", " — 2024-01-02 x", " — 12", "—", "- ", "﻿"]


def test_best_matches_of_long_texts(spark):
    words = [f"w{i}" for i in range(20_000)]
    rows = [("a", i, " ".join(words[i:])) for i in range(1, 9)] + [("a", 0, None), ("b", 1, "x x  y"), ("b", 2, "x x  y"), ("c", 3, "x"), ("d", 1, "x")]
    entries = spark.createDataFrame(rows, "path string, start_line int, fact string")
    wanted = spark.createDataFrame([("a", " ".join(words[3:])), ("b", "x  z"), ("b", "y"), ("c", None), ("e", "x")], "path string, wanted string")
    began = time.perf_counter()
    got = {(r["path"], (r["wanted"] or "-")[:4]): (r["shared"], r["start_line"]) for r in fc.best_matches(entries, wanted).collect()}
    assert got == {("a", "w3 w"): (19_997, 1), ("b", "x  z"): (3, 1), ("b", "y"): (1, 1), ("c", "-"): (0, 3)}
    assert time.perf_counter() - began < 60


def test_entry_fact_is_the_pattern(spark):
    """Against the one pattern, in Python, where what ends a line is spelled out."""
    pick = random.Random(3)
    lines = [pick.choice(["- ", "- ", "- ", "-", " - "]) + "".join(pick.choice(PIECES) for _ in range(pick.randint(0, 8))) for _ in range(20_000)]
    b = f"[{tx.BLANKS}]+"
    whole = re.compile(rf"- ([^\n\r  ]+?)(?:{b}\[ref:[^\n\r]*?\])?(?:{b}_\(source:[^\n\r]*?\)_)?(?:{b}—{b}[0-9]{{4}}[^\n\r]*)?")
    want = [m[1] if (m := whole.fullmatch(x)) else None for x in lines]
    table = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", tx.entry_fact(F.col("line")).alias("fact"))
    assert [r["fact"] for r in table.orderBy("i").collect()] == want
    assert 1000 < sum(x is not None for x in want) < 19_000


@pytest.mark.parametrize("rule", [tx.entry_fact, tx.normalized, lambda c: tx.compact_snippet(c, F.lit("memory"))])
def test_long_blanks_in_an_entry(spark, rule):
    table = spark.createDataFrame([("- a" + " " * 60_000 + "b [ref:x]",)], "line string")
    began = time.perf_counter()
    assert table.select(rule(F.col("line")).alias("x")).first()["x"].startswith(("a ", "- a b"))
    assert time.perf_counter() - began < 20


@needs_tables
def test_a_small_file_is_dealt_to_all_cores(spark):
    assert catalogue._facts(spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
