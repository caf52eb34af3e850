"""Very long and unbroken texts: each operator that reads texts itself stays linear and loses nothing."""

from __future__ import annotations

import random
import re
import time

import pytest
from tidepool.llm import html_extraction as HX
from tidepool.llm import secret_scan as SS
from tidepool.llm import token_packing as TP


@pytest.fixture(scope="module")
def encoding():
    return TP.load_encoding(TP.token_file("byte_bpe_50k.tiktoken"))


def test_white_space_is_encoded_as_by_the_tokenizer(encoding):
    rng = random.Random(2)
    parts = [" " * 1500, " " * 2000 + "\n" * 40, "\n" * 1100, "\t" * 1024, " " * 1023, "　" * 1030, "\x1c" * 1100, "word", "a b c", " ", "é", "!!", "1"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(6))
        assert TP.encoded(encoding, text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("unit", [" ", "\n", "a", "#", "é"])
def test_two_million_of_one_character_are_packed(encoding, unit):
    start = time.perf_counter()
    text = f"x{unit * 2_000_000}y"
    ids = TP.encoded(encoding, text)
    assert encoding.decode(ids) == text and time.perf_counter() - start < 20


def test_packing_survives_white_space(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000), (2, "a b"), (3, "\n" * 1_500_000 + "end")], "doc_id long, text string")
    rows = TP.segments(TP.packed(docs)).groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in rows} == {1, 2, 3} and min(r[1] for r in rows) == 3


@pytest.mark.parametrize("unit", ["<a ", '<p x="', "<!--", '<p x="<', "</a ", "<?x", "<![CDATA["])
def test_unclosed_tags_are_linear(unit):
    start = time.perf_counter()
    assert len(HX.main_text("<body><p>before</p>" + unit * 100_000)) > 100_000
    HX.main_text("<body><p>before</p>" + unit * 100_000 + ">")
    assert time.perf_counter() - start < 20
    assert HX.main_text("<body><p>one</p><p>2 &lt; 3 &amp; 4 <b") == "one 2 < 3 & 4 <b"


@pytest.mark.parametrize("unit", ["token1", "token_", "a=", "key.", "pass", "secret-", "token is "])
def test_chains_of_names_are_linear(unit):
    start = time.perf_counter()
    SS.spans(unit * 100_000)
    assert time.perf_counter() - start < 10


def test_contexts_are_those_of_one_pattern():
    """The scan in steps against one expression that says the same."""
    whole = re.compile(
        r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|bearer|auth(?:orization)?|credentials?|(?:api|access|private|secret|signing|encryption)[_-]?key)(?:[_.-]?[A-Za-z0-9]+){0,4}+"
        r"[\"']?\s{0,3}(:|=>|:=|=|\bis\b)(\s{0,3})([\"']?)(?:bearer\s)?([^\s\"'<>,;`]{8,})",
        re.A | re.I,
    )
    rng = random.Random(1)
    parts = ["token", "pass", "word", "key", "secret", "api", "_", "-", ".", "1", "a", " ", ": ", "=", "=>", "is ", '"', "abcdefgh1", "é", "Bearer ", "\n", "auth", "access_key", "secret_key", "x9", "::", ","]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(2, 14)))
        assert [(m.span(4), m[1], m[2], m[3]) for m in SS.contexts(text)] == [(m.span(4), m[1], m[2], m[3]) for m in whole.finditer(text)]


def test_costs_are_part_of_the_digest(spark):
    docs = spark.createDataFrame([(1, "password = hunter2hunter2 and token: zQ8v1kX0pLw3"), (2, "nothing"), (3, "İİİİ token: İİabcdefgh")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in SS.secret_digests(docs).collect()}
    costs = [c for *_, c in SS.spans("password = hunter2hunter2 and token: zQ8v1kX0pLw3")]
    assert got[1]["least_cost"] == pytest.approx(min(costs), abs=3) and got[2]["least_cost"] is None
