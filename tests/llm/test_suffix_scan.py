import random

import numpy as np
import pyarrow as pa

from echosieve.llm import suffix


def test_texts_scanned_together_as_alone(monkeypatch):
    rng = random.Random(5)
    own = ["".join(rng.choice("ab c") for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    texts = own + [own[0] * 3, "z" * 500, None, "", "x" * 63, "y" * 64, own[1] + own[1], "w" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    rows = {}
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(suffix, "SCAN_BYTES", size)
        rows[size] = [r for b in suffix._scan(64, 16)([batch]) for r in b.to_pylist()]
    assert rows[1] == rows[1000] == rows[1 << 20]
    assert len(rows[1]) == len(texts)
    for text, r in zip(texts, rows[1]):
        raw = (text or "").encode()
        at, fp, _ = suffix.anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]), 64, 16)
        assert set(r["fp"]) == set(fp.view(np.int64).tolist()) and set(r["at"]) <= set(at.tolist())
