from __future__ import annotations

import random
from itertools import combinations

from scoreline.llm import decontaminate
from tests.llm.fixtures import documents


def test_edited_copies_of_an_item_that_a_third_of_the_documents_hold(spark):
    draw = random.Random(4)
    item = [f"i{k}" for k in range(15)]
    copies = [item] * 2000
    for edits in combinations(range(15), 3):  # each leaves at least four seeds
        copies.append(["edited" if k in edits else w for k, w in enumerate(item)])
    texts = [" ".join([f"w{draw.randint(0, 5000)}" for _ in range(20)] + copy) for copy in copies]
    texts += [" ".join(f"w{draw.randint(0, 5000)}" for _ in range(40)) for _ in range(2 * len(texts))]
    items = spark.createDataFrame([(0, " ".join(item))], "item_id int, text string")
    rows = documents(spark, texts)
    assert {r.doc_id for r in decontaminate.matches(rows, items).collect()} == set(range(len(copies)))
    kept = {r.doc_id for r in decontaminate.clean_documents(rows, items).collect()}
    assert kept == set(range(len(copies), len(texts)))
