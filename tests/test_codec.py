from __future__ import annotations

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.sources import codec, compressed
from tidewake.types import Schema, Type

I32, I64, F64, BOOL, TS, STR = Type
WIDE = {F64: (np.float64, 64), TS: (np.int64, 64), I64: (np.int64, 64), I32: (np.int32, 32)}


def edges(kind):
    """The raw bits of values at the borders of a type, from numpy's own description of it."""
    dtype, width = WIDE[kind]
    if kind is not F64:
        info = np.iinfo(dtype)
        return [int(x) & ((1 << width) - 1) for x in (0, 1, -1, info.max, info.min, info.max - 1, info.min + 1)]
    info = np.finfo(np.float64)
    some = np.array([0, info.tiny, info.smallest_subnormal, info.max, info.eps, np.inf, np.nan])
    return [int(x) for x in np.concatenate([some, -some]).view(np.uint64)] + [int(np.float64(np.nan).view(np.uint64)) ^ (1 << b) for b in (0, 17, 50)]


@pytest.mark.parametrize("kind", list(WIDE))
@settings(max_examples=150, deadline=None)
@given(data=st.data())
def test_round_trip_bit_for_bit(kind, data):
    dtype, width = WIDE[kind]
    bits = data.draw(st.lists(st.integers(0, (1 << width) - 1) | st.sampled_from(edges(kind)) | st.integers(0, 9), max_size=40))
    values = np.array(bits, f"<u{width // 8}").view(dtype)
    back = codec.decode(codec.encode(values, kind), len(values), kind)
    assert back.dtype == dtype and back.tobytes() == values.tobytes()


@given(st.lists(st.booleans(), max_size=40))
def test_booleans_round_trip(values):
    assert codec.decode(codec.encode(np.array(values, bool), BOOL), len(values), BOOL).tolist() == values


def slow_floats(values):
    """The stream of floats by its definition, bit by bit."""
    bits = [int(x) for x in values.view(np.uint64)]
    out, lead, size = [format(bits[0], "064b")], None, None
    for before, now in zip(bits, bits[1:], strict=False):
        x = format(before ^ now, "064b")
        if "1" not in x:
            out.append("0")
            continue
        zeros, end = min(31, x.index("1")), x.rindex("1") + 1
        if lead is not None and zeros >= lead and end <= lead + size:
            out.append("10" + x[lead : lead + size])
        else:
            lead, size = zeros, end - zeros
            out.append("11" + format(lead, "05b") + format(size % 64, "06b") + x[lead:end])
    whole = "".join(out)
    return int(whole.ljust(-(-len(whole) // 8) * 8, "0"), 2).to_bytes(-(-len(whole) // 8), "big")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 300).map(lambda k: int(np.float64(k / 4).view(np.uint64))), min_size=1, max_size=60))
def test_streams_of_floats(bits):
    values = np.array(bits, np.uint64).view(np.float64)
    assert codec.encode_floats(values) == slow_floats(values)


def test_random_round_trips():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 500, 3000):
        bits = rng.integers(0, 2**64, n, np.uint64, endpoint=False)
        assert codec.decode_floats(codec.encode_floats(bits.view(np.float64)), n).view(np.uint64).tolist() == bits.tolist()
        assert codec.decode_ints(codec.encode_ints(bits.view(np.int64))).tolist() == bits.view(np.int64).tolist()


def test_streams_that_end_within_a_window():
    """Few meaningful bits, so that the last window's header and payload lie in the stream's last bytes."""
    for shift in range(64):
        for size in range(1, 12):
            bits = np.array([0, ((1 << size) - 1) << shift & (1 << 64) - 1, 5], np.uint64)
            for n in (2, 3):
                assert codec.decode_floats(codec.encode_floats(bits[:n].view(np.float64)), n).view(np.uint64).tolist() == bits[:n].tolist()


def test_known_bytes():
    assert codec.varints(np.array([0, 127, 128, 300], np.uint64)) == bytes([0, 127, 128, 1, 172, 2])
    assert codec.zigzag(np.array([0, -1, 1, -2])).tolist() == [0, 1, 2, 3]
    assert codec.encode_floats(np.array([1.5, 1.5])) == struct.pack(">d", 1.5) + b"\x00"


def test_tables(spark):
    data = [(i if i % 7 else None, float(i) * 0.1 if i % 5 else None, i % 2 == 0 if i % 3 else None, -i) for i in range(1000)]
    df = spark.createDataFrame(data, "a bigint, b double, c boolean, d int")
    schema = Schema([("a", I64), ("b", F64), ("c", BOOL), ("d", I32)])
    for rows in (64, 5000):
        blocks = compressed.encode(df, schema, rows)
        assert sorted(compressed.decode(blocks, schema).collect(), key=lambda r: -r.d) == [tuple(r) for r in data]
    assert compressed.decode(blocks, schema, ["d", "b"]).columns == ["d", "b"]
    one = compressed.sizes(blocks, schema).first()
    assert one["rows"] == 1000 and one["uncompressed_bytes"] == 21_000 and one["compressed_bytes"] == sum(one[f"{f.name}_bytes"] for f in schema)
    nothing = spark.createDataFrame([(None,)] * 20, "a bigint")
    assert compressed.decode(compressed.encode(nothing), Schema([("a", I64)])).distinct().collect() == [(None,)]
    with pytest.raises(ValueError):
        compressed.encode(spark.createDataFrame([("x",)], "s string"))
