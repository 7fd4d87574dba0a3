"""Flat token files of any size and streams whose scan takes several groups of blocks."""

import numpy as np
import pytest
from factdrift.llm import token_counts

STREAM = "stream string, block long, data binary"


def by_hand(ids, end):
    """(index, tokens, ended) of each document, one id at a time."""
    out, n = [], 0
    for x in ids:
        if x == end:
            out.append((len(out), n, True))
        n = 0 if x == end else n + 1
    return [*out, (len(out), n, False)] if n else out


def counted(blocks, end, width):
    rows = token_counts.count_tokens(blocks, end, width).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.doc_index):
        found.setdefault(r.stream, []).append((r.doc_index, r.n_tokens, r.ended))
    return found


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 26])
def test_groups_of_blocks_are_stitched(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(token_counts, "SCAN_GROUP", 3)
    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", broadcast_bytes)
    rng = np.random.default_rng(7)
    streams = {name: rng.choice(4, 90, p=(p, *[(1 - p) / 3] * 3)) for name, p in (("often", 0.4), ("rare", 0.02), (None, 0.1), ("never", 0))}
    rows = [
        (name, k, bytearray(np.array(ids[at : at + 2], "<u2").tobytes()))
        for name, ids in streams.items()
        for k, at in enumerate(range(0, len(ids), 2))
    ]
    rows += [("often", 7, None), ("rare", 8, bytearray()), ("nothing", 0, None)]
    frame = spark.createDataFrame(rows, STREAM).repartition(5)
    assert counted(frame, 0, 2) == {name: by_hand(ids, 0) for name, ids in streams.items()}


def test_repeated_blocks_count_each(spark):
    one = bytearray(np.array([5, 0, 6], "<u4").tobytes())
    frame = spark.createDataFrame([("s", 0, one), ("s", 0, one), ("s", 1, one)], STREAM)
    assert counted(frame, 0, 4) == {"s": by_hand([5, 0, 6] * 3, 0)}


def test_blocks_are_searched_once(spark, monkeypatch):
    plans, columns = [], {}
    stage = token_counts.stage

    def noted(df, label):
        columns[label] = df.columns
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(token_counts, "stage", noted)
    frame = spark.createDataFrame([("s", 0, bytearray(b"\1\0\0\0"))], STREAM)
    counts = token_counts.count_tokens(frame, 0)
    plans.append(counts._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("MapInArrow") for p in plans) == 1
    assert "ends" in columns["token-ends"] and "ends" not in columns["token-sums"]


@pytest.mark.parametrize("whole_bytes", [1, 24, 1000, 1 << 20])
@pytest.mark.parametrize("block_bytes", [1, 7, 16, 1 << 10])
def test_files_by_ranges_and_whole(spark, tmp_path, whole_bytes, block_bytes):
    rng = np.random.default_rng(3)
    files = {"a b.bin": rng.integers(0, 5, 301), "c.bin": rng.integers(0, 2, 4), "empty.bin": np.zeros(0)}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u4").tobytes())
    found = counted(token_counts.flat_file_blocks(spark, str(tmp_path), block_bytes, whole_bytes), 0, 4)
    assert {name.rsplit("/", 1)[1]: docs for name, docs in found.items()} == {
        name: by_hand(ids, 0) for name, ids in files.items() if len(ids)
    }
