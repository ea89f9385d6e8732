"""The shard of every record, computed anew without Spark."""

import math
import struct

import cases
import xxhash
from cases import docs  # noqa: F401

from leaksieve.llm import sharding


def winner(key, weights):
    """Rendezvous hashing by the published 64-bit hash, chained over shard number and key."""
    best = None
    for number, weight in enumerate(weights):
        value = xxhash.xxh64_intdigest(struct.pack("<i", number), seed=42)
        if key is not None:
            value = xxhash.xxh64_intdigest(struct.pack("<q", key) if isinstance(key, int) else key.encode(), seed=value)
        draw = ((value >> 11) + 0.5) / 2**53
        score = -weight / math.log(draw)
        if best is None or score > best[0]:
            best = score, number
    return best[1]


def test_shards_of_documents(docs):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.shard, r.grown_shard) == (winner(r.doc_id, [1.0] * 8), winner(r.doc_id, [1.0] * 9))
        assert r.grown_shard in (r.shard, 8)


def test_weights_and_string_keys(spark):
    frame = spark.createDataFrame([(f"k{n}" if n % 11 else None,) for n in range(3000)], "key string")
    weights = [1.0, 3.0, 0.5]
    rows = sharding.assign_shards(frame, ["key"], weights).collect()
    assert all(r.shard == winner(r.key, weights) for r in rows)
    shares = [sum(r.shard == s and r.key is not None for r in rows) / sum(r.key is not None for r in rows) for s in range(3)]
    assert all(abs(x - w / sum(weights)) < 0.03 for x, w in zip(shares, weights))
