from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

from scoreline.llm import decontaminate, warc
from tests.llm.fixtures import awkward, documents, nothing


def slow_alignment(a, b):
    best, table = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if x == y else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best


def test_alignment_scores_are_those_of_the_full_table():
    draw = random.Random(0)
    for _ in range(300):
        a, b = ([draw.randint(1, 5) for _ in range(draw.randint(1, 25))] for _ in range(2))
        score, start, end = decontaminate.align(np.array(a), np.array(b))
        assert score == slow_alignment(a, b)
        assert score == slow_alignment(a, b[start:end])


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    items = [[draw.choice(words) for _ in range(30)] for _ in range(12)] + [["single"], ["two", "words"], []]
    texts, want = [], set()
    for d in range(150):
        text = [draw.choice(words) for _ in range(draw.randint(50, 300))]
        if d % 3 == 0:
            k = d % 12
            edited = [w for w in items[k] if draw.random() > 0.06]
            edited = [draw.choice(words) if draw.random() < 0.08 else w for w in edited]
            at = draw.randint(0, len(text))
            text[at:at] = edited
            want.add((d, k))
        texts.append(" ".join(text).title() + ", !")
    texts += ["a single thing", "the two words"]
    want |= {(150, 12), (151, 13)}
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id int, text string")
    return documents(spark, texts), benchmark, want


def test_edited_items_are_found_and_nothing_else(planted):
    docs, items, want = planted
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert found == want
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(152)) - {d for d, _ in want}


def test_blocks_of_items_give_the_same(planted, monkeypatch):
    docs, items, want = planted
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == want


def test_decontamination_awkward_rows(spark, planted):
    _, items, _ = planted
    assert decontaminate.matches(awkward(spark), items).count() == 0
    assert decontaminate.clean_documents(awkward(spark), items).count() == 13
    assert decontaminate.matches(nothing(spark), items).count() == 0
    assert decontaminate.clean_documents(awkward(spark), items.limit(0)).count() == 13
    assert decontaminate.matches(awkward(spark), items.limit(0)).count() == 0


def pages(spark):
    big = "".join(random.Random(1).choice("aé<>\r\n \U0001f600") for _ in range(120_000))
    rows = [(5, "http://a/\r\nX: y", big), (1, None, None), (2, "u", ""), (3, "u", "same"), (4, "u", "same"),
            (9, "u", big), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\n0\r\n\r\n"), (7, "u", "x" * 70_000)]
    return spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id long, url string, html string, first int, sha string")


def test_pages_survive_the_round_trip(spark):
    rows = pages(spark).collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(r.html or "", r.page_id)
    want = set()
    for r in rows:
        data, own = (r.html or "").encode(), first[r.html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = own != r.page_id
        want.add((r.page_id, len(data), digest, "revisit" if again else "response", own if again else None, None))
    found = warc.warc_round_trip(pages(spark))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
    assert {tuple(r[c] for c in names) for r in found.collect()} == want
    assert warc.warc_round_trip(pages(spark).limit(0)).count() == 0


def test_segments_out_of_order_lost_or_short(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "w"), segment=1000)
    segments = warc.read_segments(spark, str(tmp_path / "w")).cache()
    assert segments.where("type = 'continuation'").count() > 100
    whole = warc.assemble(segments.orderBy("z"))
    payload = {r.page: r.payload for r in whole.where("record_type = 'response'").collect()}
    assert payload["5"] == pages(spark).where("page_id = 5").first().html.encode()
    lost = warc.assemble(segments.where("number <> 3")).where("problem IS NOT NULL")
    assert {r.page for r in lost.collect()} == {"5", "7"}
    last = segments.where("total IS NOT NULL").selectExpr("max(number)").first()[0]
    short = warc.assemble(segments.where(f"number <> {last}")).where("problem = 'total length differs'")
    assert short.count() == 1


def test_pages_without_ids_and_repeated_ones(spark):
    rows = [(None, "u", "a"), (None, "u", "b"), (3, "u", "c"), (3, "u", "c")]
    found = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 4 and all(r.problem is None for r in found)


def test_chunked_framing():
    text = "é" * 9000 + "\r\n0\r\n\r\n"
    assert warc.dechunked(warc.chunked(text).encode()) == text.encode()
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
