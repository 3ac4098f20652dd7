import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glossweave.llm import mph, tokenfile
from glossweave.llm.common import shared
from glossweave.llm.tokenfile import write_and_read

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_hash_is_minimal_and_perfect():
    for n in (1, 2, 3, 10, 5000):
        keys = mph.mix(np.arange(n, dtype=np.uint64))
        assert sorted(mph.find(mph.build(keys), n, keys)) == list(range(n))


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_files_come_back(spark, monkeypatch, bound):
    monkeypatch.setattr(tokenfile, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(tokenfile, "SHARD_ROWS", 40)
    tok = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 501, f"text {i}\nwith  lines" * (i % 9)) for i in range(500)] + [(7, "again"), (7, "again"), (9000, None), (9001, ""), (None, "no key"), (-5, "é" * 90000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, content string, n long")
    got = write_and_read(df, PATH, shard_bytes=4_000).collect()
    expected, start = [], 0
    for k, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected
    assert write_and_read(df.where("false"), PATH).collect() == []


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_ids_by_key(spark, monkeypatch, bound):
    monkeypatch.setattr(tokenfile, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(tokenfile, "SHARD_ROWS", 40)
    tok = Tokenizer.from_file(PATH)
    rows = [(i * 3, f"text number {i}") for i in range(300)] + [(9, "again"), (None, "no key")]
    path = f"{shared(spark)}/ids"
    tokenfile.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, "byte", 2, 2, 4_000)
    index, _, buckets = tokenfile.build_index(spark, path)
    keys = spark.createDataFrame([(3, 0), (9, 0), (9, 1), (9, 2), (897, 0), (None, 0), (None, 1), (4, 0), (-1, 0), *((10**6 + i, 0) for i in range(500))], "doc_id long, nth long")
    got = {(r.doc_id, r.nth): list(r.ids) for r in tokenfile.get(spark, path, index, buckets, keys).collect()}
    ids = lambda t: [*tok.encode(t, add_special_tokens=False).ids, 2]
    assert got == {(3, 0): ids("text number 1"), (9, 0): ids("again"), (9, 1): ids("text number 3"), (897, 0): ids("text number 299"), (None, 0): ids("no key")}
    # A false place, as a fingerprint of a key that was never stored could give, is no row.
    place = spark.createDataFrame([(3, 0, 0, 1, 2), (5, 0, 0, 0, 1)], "key long, nth long, shard long, first long, n long")
    assert tokenfile.fetch(spark, path, place).count() == 0


def test_sums_of_shards_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 7)
    totals = spark.createDataFrame([(i, i * i + 1) for i in range(50) if i % 5], "shard long, ids long")
    got = {r.shard: r.before for r in tokenfile.before(totals).collect()}
    assert got == {i: sum(j * j + 1 for j in range(i) if j % 5) for i in range(50) if i % 5}
