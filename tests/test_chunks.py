"""Layout and chunks of pages: whole pages, linear time, and the rules that chunks keep."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from tidepool.operators import corpus as C
from tidepool.sources.shared import pieces


def page(rng, n):
    return [{"kind": "heading" if rng.random() < 0.25 else "para", "depth": rng.randint(1, 3), "text": "x" * rng.choice([5, 60, 400, 1300])} for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_keep_their_rules(spark, seed):
    rng = random.Random(seed)
    pages = [(i, page(rng, rng.choice([0, 1, 2, 9, 40]))) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, blocks array<struct<kind:string,depth:int,text:string>>")
    laid = {r["page_id"]: r for r in C.laid_out(df).collect()}
    got: dict[int, list] = {i: [] for i, _ in pages}
    for r in C.chunks(C.laid_out(df)).orderBy("page_id", "start").collect():
        got[r["page_id"]].append(r)
    for i, blocks in pages:
        text, placed = laid[i]["text"], laid[i]["blocks"]
        assert text == "\n\n".join(b["text"] for b in blocks) and all(text[b["start"] : b["end"]] == b["text"] for b in placed)
        starts, ends = [b["start"] for b in placed], [b["end"] for b in placed]
        assert [r["text"] for r in got[i]] == [text[r["start"] : r["end"]] for r in got[i]]
        spans = [(starts.index(r["start"]), ends.index(r["end"])) for r in got[i]]
        assert [p for first, last in spans for p in range(first, last + 1)] == list(range(len(blocks)))  # every block once, in order
        for at, (first, last) in enumerate(spans):
            own = placed[first : last + 1]
            prose = [b["kind"] != "heading" for b in own]
            if at < len(spans) - 1:
                assert any(prose)
                full = own[-1]["end"] - own[0]["start"] >= C.TARGET
                assert full or placed[last + 1]["kind"] == "heading"
                assert not any(any(prose[: k + 1]) and own[k]["end"] - own[0]["start"] >= C.TARGET for k in range(len(own) - 1))
            heads = [b for b in placed[: first + 1] if b["kind"] == "heading"]
            want = [h["text"] for k, h in enumerate(heads) if all(x["depth"] > h["depth"] for x in heads[k + 1 :])]
            assert got[i][at]["heading_path"] == want


def test_a_page_of_many_blocks_is_linear(spark):
    blocks = [{"kind": "heading" if i % 50 == 0 else "para", "depth": 1 + i % 3, "text": f"block {i}"} for i in range(100_000)]
    df = spark.createDataFrame([(1, blocks)], "page_id long, blocks array<struct<kind:string,depth:int,text:string>>")
    start = time.perf_counter()
    assert C.chunks(C.laid_out(df)).count() > 900
    assert time.perf_counter() - start < 30


def test_a_batch_is_read_in_pieces_of_a_stated_size():
    """Whole batches as Python objects are what took an executor's memory."""
    rows = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["x" * (10_000 if i == 400 else 100) for i in range(500)])], ["page_id", "html"])
    some = list(pieces([rows, rows.slice(0, 0)], size=5_000))
    assert len(some) > 10 and pa.Table.from_batches(some) == pa.Table.from_batches([rows])
    assert all(p.num_rows * rows.nbytes / rows.num_rows <= 5_000 for p in some)
