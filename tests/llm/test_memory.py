"""What the workers of the text operators keep and take."""

import random
import string
import tracemalloc

import numpy as np

from stockwright.llm import bpe, language
from stockwright.llm.common import held
from stockwright.llm.queries import VOCABULARY
from stockwright.session import prepare


def test_a_worker_keeps_one_operators_tables():
    with open(VOCABULARY, encoding="utf-8") as f:
        source = f.read()
    first = language._vectors()
    assert language._vectors() is first
    made = bpe.load(source, numbers=False)
    assert bpe.load(source, numbers=False) is made
    assert language._vectors() is not first
    assert held("other", list) is held("other", list)


def test_encoding_many_new_pieces_takes_little_memory():
    with open(VOCABULARY, encoding="utf-8") as f:
        made = bpe.Bpe(f.read(), numbers=False)
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices(string.ascii_lowercase, k=12)) for _ in range(250)) for _ in range(300)]  # 975,000 letters
    tracemalloc.start()
    total = sum(len(ids) for ids, _ in made.encode_batch(texts))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert total > 300_000 and most < 70
    assert not made.text


def test_trigram_vectors_are_small():
    made = language.Vectors()
    found = made.bundle(["the quick brown fox", "1 2 3"])
    assert made.rows.dtype == np.int8 and found.dtype == np.float32 and found[0].any() and not found[1].any()


def test_long_texts_come_in_small_batches(spark):
    prepare(spark)
    rows = spark.range(400, numPartitions=1).selectExpr("id", "repeat('a b c d e f ', 10000) as text")  # 48 MB

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"mb": [b.nbytes >> 20]})

    assert max(r.mb for r in rows.mapInArrow(run, "mb bigint").collect()) <= 9
