"""The fit of toxicity holds the words of one text, not those of a batch."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from arbelo.llm import toxicity


def test_words_of_a_batch_are_not_kept():
    text = " ".join(f"word{i}" for i in range(500))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 400 + [None, ""]), pa.array([0] * 402, pa.int32()), pa.array([0, 1] * 201, pa.int32())], names=["text", "y", "half"])
    tracemalloc.start()
    out = list(toxicity._segment_scores([batch], [{b"word1": 1.0}, {b"word1": 3.0}]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000  # the words alone of all texts take over 7 MB
    assert out[0].column(1).to_pylist()[:1] == [500] and out[0].column(1).to_pylist()[-2:] == [0, 0]
    assert out[0].column(2).to_pylist()[0] == [2.5] and out[0].column(2).to_pylist()[1] == [0.5]
