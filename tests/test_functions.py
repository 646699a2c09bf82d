import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import bits, geometry, names
from gridloom.operators import codec
from gridloom.plans import settings as text_settings


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_varints_round_trip(values):
    data = bits.varints(np.array(values, np.uint64))
    assert bits.unvarints(data).tolist() == values
    assert len(data) == sum(max(1, -(-v.bit_length() // 7)) for v in values)


def test_varint_cut_off():
    with pytest.raises(ValueError):
        bits.unvarints(b"\x80")


@pytest.mark.parametrize("spanning", [True, False])
def test_bit_storage(spanning):
    rng = np.random.default_rng(1234)
    for width in range(1, 31):
        v = rng.integers(0, 1 << width, int(rng.integers(1000, 1024)))
        words = bits.pack_bits(v, width, spanning)
        assert len(words) == (-(-len(v) * width // 64) if spanning else -(-len(v) // (64 // width)))
        assert (bits.unpack_bits(words, width, len(v), spanning) == v).all()


def test_bit_stream():
    w = bits.BitWriter()
    for i in range(4096):
        w.put(i, 1 + i % 31)
    r = bits.BitReader(w.close())
    assert all(r.get(1 + i % 31) == i & (1 << 1 + i % 31) - 1 for i in range(4096))


def test_columns_of_edge_values(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, -1, 2, -(2**62), 2**62 - 1, 127, 128, 16384)], "v long")
    for r in df.select("v", bits.zigzag(F.col("v")).alias("z"), bits.unzigzag(bits.zigzag(F.col("v"))).alias("b")).collect():
        assert r.z == (2 * r.v if r.v >= 0 else -2 * r.v - 1) and r.b == r.v
    got = {r.v: r.n for r in df.filter("v >= 0").select("v", bits.varint_size(F.col("v")).alias("n")).collect()}
    assert (got[0], got[127], got[128], got[16384]) == (1, 1, 2, 3)


def test_names(spark):
    row = spark.range(1).select(
        names.resource_namespace(F.lit("stone")).alias("a"), names.resource_path(F.lit("x:y/z")).alias("b"),
        names.state_properties(F.lit("bed[part=head,facing=east]")).alias("c"), names.state_string(F.lit("stone"), F.create_map().cast("map<string,string>")).alias("d"),
        names.inside(F.lit("a/../b"), "r").alias("e"), names.inside(F.lit("a/../../b"), "r").alias("f"), names.inside(F.lit("/etc"), "r").alias("g"),
        names.is_gzip(F.lit(b"\x1f\x8b\x08" + bytes(7))).alias("h"), names.is_gzip(F.lit(b"\x1f\x8b\x08")).alias("i"), names.region_position(F.lit("w/r.-1.2.mca"))[0].alias("j"), names.region_position(F.lit("r.x.mca"))[0].alias("k"), names.duration(F.lit(3725)).alias("l"),
    ).first()
    assert row.asDict() == {"a": "minecraft", "b": "y/z", "c": {"part": "head", "facing": "east"}, "d": "stone", "e": True, "f": False, "g": False, "h": True, "i": False, "j": -32, "k": None, "l": "1h 2m 5s"}


FULL, LOW, HIGH = [0, 0, 0, 16, 16, 16], [0, 0, 0, 16, 8, 16], [0, 8, 0, 16, 16, 16]
OUTLINE = [[a, b, c, d, e, f] for a, b, c, d, e, f in (
    (0, 0, 0, 16, 2, 2), (0, 0, 14, 16, 2, 16), (0, 14, 0, 16, 16, 2), (0, 14, 14, 16, 16, 16),
    (0, 0, 0, 2, 2, 16), (14, 0, 0, 16, 2, 16), (0, 14, 0, 2, 16, 16), (14, 14, 0, 16, 16, 16),
    (0, 0, 0, 2, 16, 2), (14, 0, 0, 16, 16, 2), (0, 0, 14, 2, 16, 16), (14, 0, 14, 16, 16, 16),
)]


@pytest.mark.parametrize(("a", "b", "mask"), [
    ([FULL], [FULL], 63), ([LOW], [HIGH], 31), ([[0, 0, 0, 8, 16, 16]], [[8, 0, 0, 16, 16, 16]], 61), ([[0, 0, 0, 16, 16, 8]], [[0, 0, 8, 16, 16, 16]], 55),
    (OUTLINE, [[0, 2, 2, 14, 14, 14]], 2), (OUTLINE, [[0, 2, 2, 16, 14, 14]], 3), (OUTLINE, [[2, 0, 2, 14, 16, 14]], 48),
    (OUTLINE, [[0, 2, 2, 2, 14, 14], [14, 2, 2, 16, 14, 14], [2, 2, 0, 14, 14, 2], [2, 2, 14, 14, 14, 16]], 15),
])
def test_shapes(spark, a, b, mask):
    assert geometry.hidden_directions(a, b) == mask
    df = spark.createDataFrame([(a, b)], "a array<array<int>>, b array<array<int>>")
    assert df.select(geometry.occlusion_mask("a", "b")).first()[0] == mask


def test_context_slot(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63 - 1, (50, 2))] + [(0, 0), (-1, -1)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", codec.context_slot_column(F.col("a"), F.col("b"), 12).alias("s"))
    for r in df.collect():
        assert r.s == codec.context_slot(r.a & codec._M64, r.b & codec._M64, 12)


def test_arithmetic_coder():
    rng = np.random.default_rng(1234)
    p = rng.integers(1, 65536, 50_000)
    data = (rng.random(50_000) * 65536 > p).astype(int)
    e = codec.Encoder()
    for b, q in zip(data.tolist(), p.tolist(), strict=True):
        e.bit(b, q)
    raw = e.close()
    d = codec.Decoder(raw)
    assert [d.bit(q) for q in p.tolist()] == data.tolist()
    share = p / 65536
    entropy = -(share * np.log2(share) + (1 - share) * np.log2(1 - share)).sum() / 8
    assert len(raw) < 1.02 * entropy + 16


@given(st.integers(1, 300), st.integers(0, 2**32))
@settings(max_examples=15, deadline=None)
def test_grid_codec(palette, seed):
    rng = np.random.default_rng(seed)
    grid = rng.integers(0, palette, tuple(rng.integers(1, 8, 3)))
    data = codec.GridCodec(palette).encode(grid)
    assert (codec.GridCodec(palette).decode(data, grid.shape) == grid).all()
    mask, near = rng.random(grid.shape) < 0.5, ((-2, 0, 0), (0, -1, 1), (1, 0, -1), (0, -3, 0))
    data = codec.GridCodec(palette, 6, near).encode(grid, mask)
    assert (codec.GridCodec(palette, 6, near).decode(data, grid.shape, mask) == np.where(mask, grid, 0)).all()


def test_adaptive_bit():
    """Start, limit and delta: the share of what is missing is 1 / (delta + bits so far), the bits counted to the limit."""
    bit, value = codec.AdaptiveBit(0.5, 3, 4), 32768.0
    for k, b in enumerate((1, 1, 0, 1, 1), 1):
        bit.learn(b)
        value += (b * 65536 - value) / (min(k, 3) + 4)
        assert bit.value == value and bit.count == min(k, 3)


@given(st.integers(0, 65535), st.data())
@settings(max_examples=100, deadline=None)
def test_numbers_up_to_a_maximum(most, data):
    numbers = data.draw(st.lists(st.integers(0, most), max_size=30))
    coder, model = codec.Encoder(), codec.NumberModel()
    for n in numbers:
        model.encode(coder, n, most)
    raw, again = coder.close(), codec.NumberModel()
    decoder = codec.Decoder(raw)
    assert [again.decode(decoder, most) for _ in numbers] == numbers
    if most == 0:
        assert len(raw) == 6  # nothing but the coder's end


def test_ranked_symbols():
    """A symbol passes those with at most its hits and a bonus that grows with the hits of the context."""
    ranks = codec.RankedSymbols(4)
    for _ in range(3):
        ranks.hit(ranks.rank(0))
    ranks.hit(ranks.rank(2))
    assert ranks.order == [0, 2, 1, 3] and ranks.total == 4  # 1 + 1 < 3 hits
    ranks.hit(ranks.rank(2))
    assert ranks.order == [2, 0, 1, 3]  # 2 + 1 reaches 3


def test_bits():
    rng = np.random.default_rng(3)
    widths = rng.integers(1, 40, 500).tolist()
    values = [int(rng.integers(0, 1 << w)) for w in widths]
    out = bits.BitWriter()
    for v, w in zip(values, widths, strict=True):
        out.put(v, w)
    data = out.close()
    assert len(data) == -(-sum(widths) // 8)
    own = bits.BitReader(data)
    assert [own.get(w) for w in widths] == values


def test_settings():
    got = text_settings.parse_list('a, b{n=1,f=-2.5,s="x\\"y",l=[1,true,null],o={k=v},t=c{}}')
    assert got[0] == text_settings.Setting("a")
    assert got[1].values == {"n": 1, "f": -2.5, "s": 'x"y', "l": [1, True, None], "o": {"k": "v"}, "t": text_settings.Setting("c")}
    for bad in ("a{", "a{b}", "a b", "{", "a{b=}"):
        with pytest.raises(text_settings.BadSettings):
            text_settings.parse_list(bad)
    with pytest.raises(text_settings.BadSettings):
        text_settings.build({}, text_settings.Setting("x"))
