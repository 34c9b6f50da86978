"""What the packing worker holds beside its words is bounded by its batches."""

import pyarrow as pa

from quillgraph.llm import packing
from quillgraph.llm.common import small_batches


def test_texts_are_encoded_a_few_megabytes_at_a_time():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9_000)), "text": ["word " * 200] * 9_000})
    parts = list(small_batches([batch], packing.BATCH_BYTES))
    assert max(p["text"].nbytes for p in parts) < 2.2 * 2**20  # before, 8 MB
    assert sum(len(p) for p in parts) == 9_000
