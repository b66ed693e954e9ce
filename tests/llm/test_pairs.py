"""Exchange of replies by rank: ids may lie any distance apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from admitlens.llm import chat


@pytest.mark.parametrize("factor, shift", [(1, 0), (10**9, 7), (10**14, -50 * 10**14)])
def test_pairs_do_not_depend_on_the_distance_of_ids(spark, monkeypatch, factor, shift):
    monkeypatch.setattr(chat, "BUCKET", 10)
    n = 37                                     # blocks of 10, 10 and 17
    rows = [(i * factor + shift, t, r, f"{r} {i} {t}") for i in range(n) for t, r in enumerate(("user", "assistant"))]
    rows += [(n * factor + shift, 0, "user", "no reply"), (None, 0, "assistant", "nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.pair_id - shift) // factor: (r.chosen[-1].text, r.rejected[-1].text) for r in chat.exchanged_replies(df).collect()}
    next_of = [0 + (i + 1) % 10 if i < 10 else 10 + (i - 9) % 10 if i < 20 else 20 + (i - 19) % 17 for i in range(n)]
    assert got == {i: (f"assistant {i} 1", f"assistant {next_of[i]} 1") for i in range(n)}
    assert all(r.valid for r in chat.preferences(chat.exchanged_replies(df)).select("valid").collect())
    assert chat.exchanged_replies(df.where(F.lit(False))).count() == 0
