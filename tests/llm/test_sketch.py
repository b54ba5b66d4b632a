"""Merged sketches and how they reach the driver."""

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from evimine.llm import _sketch, _text
from evimine.llm._spark import ship


def test_the_driver_receives_few_blocks_at_a_time(spark, monkeypatch):
    """All blocks in one result took several times the sketch's size of the driver's memory."""
    ship(spark)
    received, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        received.append(len(rows))
        return rows

    def names(batch):
        yield _text.mix(batch.column("id").to_numpy().astype(np.uint64) % np.uint64(3000))

    monkeypatch.setattr(DataFrame, "collect", counted)
    df = spark.range(4000).repartition(5)
    all_ = _text.mix((np.arange(4000) % 3000).astype(np.uint64))
    bitmaps = _sketch.repeated(df, names, 14)
    assert sum(received) == 128 and max(received) <= 2 * _sketch.AT_ONCE
    for row, bitmap in enumerate(bitmaps):
        want = np.bincount(_sketch.cells_of(all_, 14, row), minlength=1 << 14) > 1
        assert (np.unpackbits(bitmap).astype(bool) == want).all()
    received.clear()
    assert (_sketch.counts(df, names, 14) == np.bincount(_sketch.cells_of(all_, 14, 0), minlength=1 << 14)).all()
    assert max(received) <= _sketch.AT_ONCE
