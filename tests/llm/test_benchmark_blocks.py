"""A benchmark of many blocks is searched one block at a time."""

from __future__ import annotations

import gc

from websieve.llm.decontaminate import Block, decontaminate


def test_one_block_at_a_time(spark, docs, monkeypatch):
    index, alive = Block.index, []

    def watched(self, frequency):
        gc.collect()
        alive.append(sum(isinstance(x, Block) for x in gc.get_objects()))
        index(self, frequency)

    monkeypatch.setattr(Block, "index", watched)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows = [(i, f"own {items[i % 12][1]} and {items[(i + 5) % 12][1]} end") for i in range(30)] + [(None, items[3][1]), (7, "other text"), (40, None)]
    few, many = (sorted(map(str, decontaminate(docs(rows).repartition(2), bench, block_words=n).collect())) for n in (10**6, 30))
    assert few == many and len(few) == 33 and len(alive) > 3 and max(alive) == 1
