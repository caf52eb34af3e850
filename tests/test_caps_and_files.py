"""Lists filled under nested caps, and note files that each say how they are to be read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tidepool.functions import scalars as S
from tidepool.operators import hierarchy as H


@pytest.mark.parametrize("seed", range(3))
def test_filled_list_equals_a_sequential_fill(spark, seed):
    rng = random.Random(seed)
    names = ["a", "a::b", "a::b::c", "a::b::d", "a::e", "f", "f::g", "f::g::h::i"]
    names += ["f::g::h"]
    caps = {n: rng.randrange(0, 9) for n in names}
    cards = [(i, rng.choice([*names, "elsewhere"]), rng.randrange(15)) for i in range(120)]
    overall = rng.choice([5, 12, 100])
    left, want = dict(caps), []
    for i, deck, due in sorted(cards, key=lambda x: (x[2], x[0])):
        above = ["::".join(deck.split("::")[: n + 1]) for n in range(deck.count("::") + 1)]
        if deck in caps and len(want) < overall and all(left[n] > 0 for n in above):
            want.append(i)
            for n in above:
                left[n] -= 1
    got = H.filled(spark.createDataFrame(cards, "id long, deck string, due int"), spark.createDataFrame(list(caps.items()), "name string, cap int"), [F.col("due")], "::", overall)
    assert [r["id"] for r in got.collect()] == want


def test_markup_is_stripped_in_one_scan(spark):
    texts = {
        "<style>p { content: '<!--' }</style>kept<!-- <b>gone</b> -->": "kept", "a<b class='x'>c</b >d": "acd", "<SCRIPT type=x>if (a < b) x()</SCRIPT >after": "after",
        "<!-- <style> -->seen<!-- </style> -->": "seen", "2 < 3": "2 < 3", "<styles>own</styles>": "own", "": "",
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.strip_html(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == texts
