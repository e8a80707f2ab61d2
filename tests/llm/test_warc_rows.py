from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

from scoreline.llm import warc


def test_null_and_repeated_ids_of_several_segments_keep_all_rows(spark):
    draw = random.Random(3)
    big = ["".join(draw.choice("abcdé<>") for _ in range(n)) for n in (9000, 5000, 7000)]
    rows = [(None, "u", big[0]), (None, "u", big[1]), (None, "u", big[1]), (3, "u", big[2]), (3, "u", big[2]),
            (3, "u", big[0]), (4, "u", big[2]), (4, "u", big[2]), (5, "u", "x" * 8000), (5, "u", "y" * 8000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = warc.warc_round_trip(pages, segment=1000).collect()
    assert all(r.problem is None for r in found)
    size = lambda t: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode())
    want = [(i, *size(t)) for i, _, t in rows]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == Counter(want)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in found)
    assert kinds == {
        (None, "response", None): 1, (None, "revisit", None): 1, (None, "revisit", 3): 1, (3, "response", None): 2,
        (3, "revisit", 3): 1, (4, "revisit", 3): 2, (5, "response", None): 2,
    }


def test_every_record_has_an_id_of_its_own(spark, tmp_path):
    rows = [(i, "u", t * 3000) for i in (None, 1, 1) for t in "aab"]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least in (0, 1 << 20):
        path = str(tmp_path / f"w{least}")
        warc.write_archives(pages, path, least_bytes=least, segment=1000)
        segments = warc.read_segments(spark, path)
        assert segments.where("number = 1").select("origin").distinct().count() == 9
        assert warc.assemble(segments).where("problem IS NOT NULL").count() == 0


def test_ids_of_any_text_come_back(spark):
    ids = ["a", "", " b ", "x\r\nWARC-Type: warcinfo", "50%", "é:/", None, "\t"]
    rows = [(i, "u", f"page {n} " * 300) for n, i in enumerate(ids)] + [("twin", "u", "page 3 " * 300)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    found = warc.warc_round_trip(pages, segment=1000).collect()
    assert all(r.problem is None for r in found)
    assert Counter(r.page_id for r in found) == Counter([*ids, "twin"])
    assert {r.page_id: r.refers_to for r in found if r.record_type == "revisit"} == {ids[3]: "twin"}
