import pytest

from siltbed.functions import hashing, wire
from siltbed.sources import sst


@pytest.mark.parametrize("key, want", [("", 0x8397626CD6895052), ("A", 0xA0375B1F280DD2A8), ("AAPL", 0xFFCC3909D79AFFA2), ("key_100", 0xE1D34DF6202EF716), ("12345678", 0xCEBDC66EE4A7E9A0), ("key_10000", 0xAC09B75C2269CDFF), ("HFT_TICK_DATA_0_", 0x9A45191EFAA4F0AD)])
def test_murmur(key, want):
    assert hashing.murmur64([key.encode()])[0] == want


def test_bloom():
    bits = hashing.bloom_build([b"AAPL", b"MSFT", b"GOOG"], 100)
    assert len(bits) == 125 and sum(b.bit_count() for b in bits) == 21
    assert hashing.probes(hashing.murmur64([b"AAPL"]), 125)[0].tolist() == [426, 155, 884, 613, 342, 71, 800]
    assert hashing.bloom_probe(bits, [b"AAPL", b"MSFT", b"GOOG", b"TSLA", b"AMZN"]).tolist() == [True] * 3 + [False] * 2
    assert not hashing.bloom_probe(b"", [b"x"])[0]
    many = hashing.bloom_build([f"key_{i}".encode() for i in range(10_000)], 10_000)
    assert len(many) == 12_500 and hashing.bloom_probe(many, [f"key_{i}".encode() for i in range(10_000, 20_000)]).sum() == 86


def test_table_layout():
    rows = [(f"key_{i}".encode(), f"value_{i}".encode()) for i in range(100, 250)]
    raw = sst.encode(rows, 1000)
    t = sst.Table(raw)
    assert len(raw) == 4947 and t.end == 3600 and list(zip(t.keys, t.offsets)) == [(b"key_100", 0), (b"key_164", 1536), (b"key_228", 3072)]
    assert list(t.scan()) == rows
    assert t.get(b"key_200") == b"value_200" and t.get(b"key_099") is None and t.get(b"zzz") is None


def test_table_refuses():
    with pytest.raises(ValueError):
        sst.encode([(b"b", b""), (b"a", b"")])
    with pytest.raises(ValueError):
        sst.Table(b"\0" * 40)
    assert list(sst.Table(sst.encode([])).scan()) == [] and sst.Table(sst.encode([])).get(b"a") is None


def test_frames_cut_and_joined():
    one = wire.HEADER.pack(2, 1, 2, 0, 2**63 + 5) + b"kvv"
    found, used = wire.walk(one + one + one[:-1])
    assert len(found) == 2 and used == 2 * len(one) and found[0][4:] == (2**63 + 5, b"k", b"vv")


def test_files_round_trip(spark, tmp_path):
    run = spark.createDataFrame([(f"k{i:03}", f"v{i}") for i in range(300)], "key string, value string")
    assert len(sst.write(run, str(tmp_path), 3)) == 3
    got = sst.read(spark, f"{tmp_path}/*.sst")
    assert sorted((bytes(r.key), bytes(r.value)) for r in got.collect()) == sorted((r.key.encode(), r.value.encode()) for r in run.collect())
    tables = spark.read.format("binaryFile").load(f"{tmp_path}/*.sst")
    assert [bytes(r.value) for r in sst.get(tables, b"k007", "content").collect()] == [b"v7"]
