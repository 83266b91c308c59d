"""Steps of the media columns."""

from __future__ import annotations

import pyarrow as pa

from rankframe.llm import media, webp


def test_files_of_a_batch_are_decoded_together(monkeypatch):
    """2 MB of files are one lockstep: its steps cost as much for few images as for many."""
    r = __import__("numpy").random.RandomState(0)
    data = [r.bytes(1 << 16) for _ in range(32)]
    files = webp.encode([media.to_image(d) for d in data], media.CACHE_BITS)
    assert sum(map(len, files)) > 2_000_000
    calls, inner = [], webp.decode
    monkeypatch.setattr(webp, "decode", lambda fs: calls.append(len(fs)) or inner(fs))
    (got,) = [images for _, images in media._decoded(iter([pa.record_batch({"media": pa.array(files, pa.binary())})]))]
    assert calls == [32] and [i.astype("<u4").tobytes() for i in got] == data
