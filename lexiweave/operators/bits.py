"""Bit vectors as rows (word_idx BIGINT, word BIGINT), 64 bits a word, the least significant first.

A vector's length isn't in its rows; functions that need it take it, and a
BitVector carries it. Bits beyond it are zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Words of a block of the searches that go over all words.
BLOCK = 1 << 16
EMPTY = "word_idx long, word long"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EMPTY)


def zeroes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(-(-n // 64)).select(F.col("id").alias("word_idx"), F.lit(0).cast("long").alias("word"))


def ones(spark: SparkSession, n: int) -> DataFrame:
    """n bits set; those of the last word beyond n aren't."""
    rest = n % 64
    last = F.lit((1 << rest) - 1 if rest else -1).cast("long")
    return spark.range(-(-n // 64)).select(F.col("id").alias("word_idx"), F.when((F.col("id") == n // 64) & F.lit(rest > 0), last).otherwise(F.lit(-1).cast("long")).alias("word"))


def pack(values: DataFrame, width: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """Values of `width` bits, the one at pos from bit pos * width on; each gives its part to one word or two.

    Raises on a value that doesn't fit. Sums of a word meet as partial `bit_or`s.
    """
    offset = F.col(pos) * width
    fits = F.lit(True) if width == 64 else F.shiftrightunsigned(F.col(value).cast("long"), width) == 0
    v = F.when(fits, F.col(value).cast("long")).otherwise(F.raise_error(F.lit(f"a value has more than {width} bits")).cast("long"))
    placed = values.select(F.floor(offset / 64).cast("long").alias("word_idx"), F.pmod(offset, F.lit(64)).cast("int").alias("shift"), v.alias("v"))
    low = F.struct(F.col("word_idx"), F.expr("shiftleft(v, shift)").alias("word"))
    high = F.struct((F.col("word_idx") + 1).alias("word_idx"), F.expr("shiftrightunsigned(v, 64 - shift)").alias("word"))
    parts = placed.select(F.explode(F.when(F.col("shift") + width > 64, F.array(low, high)).otherwise(F.array(low))).alias("p")).select("p.*")
    return parts.groupBy("word_idx").agg(F.expr("bit_or(word)").alias("word"))


def unpack(words: DataFrame, width: int, positions: DataFrame, pos: str = "pos") -> DataFrame:
    """positions with `value`, the `width` bits (0 to 64) from bit pos * width on; null where the vector has no such bits."""
    return get_bits(words, positions.withColumn("_at", F.col(pos) * width), "_at", width).drop("_at")


def get_bits(words: DataFrame, asked: DataFrame, at: str, width: int, length: int | None = None) -> DataFrame:
    """asked with `value`: `width` bits from bit `at` on. Null beyond the vector and for a width over 64; 0 for width 0."""
    if width > 64 or width < 0:
        return asked.withColumn("value", F.lit(None).cast("long"))
    end = F.col(at) + width
    needed = asked.withColumn("_w", F.floor(F.col(at) / 64).cast("long")).withColumn("_next", F.when(F.pmod(F.col(at), F.lit(64)) + width > 64, F.col("_w") + 1))
    low = words.select(F.col("word_idx").alias("_w"), F.col("word").alias("_low"))
    high = words.select(F.col("word_idx").alias("_next"), F.col("word").alias("_high"))
    joined = needed.join(low, "_w", "left").join(high, "_next", "left").withColumn("_s", F.pmod(F.col(at), F.lit(64)).cast("int"))
    both = F.when(F.col("_next").isNull(), F.expr("shiftrightunsigned(_low, _s)")).otherwise(F.expr("shiftrightunsigned(_low, _s) | shiftleft(_high, 64 - _s)"))
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    value = F.lit(0).cast("long") if width == 0 else both.bitwiseAND(mask)
    inside = (F.col(at) >= 0) & (F.lit(True) if length is None else end <= length)
    return joined.withColumn("value", F.when(inside, value)).drop("_w", "_next", "_low", "_high", "_s")


def get(words: DataFrame, asked: DataFrame, at: str, length: int | None = None) -> DataFrame:
    """asked with `value`: the bit at `at`, null beyond the vector."""
    return get_bits(words, asked, at, 1, length)


def set_bits(words: DataFrame, changes: DataFrame) -> DataFrame:
    """The vector with the bits of changes (pos, bit 0 or 1; each pos once) overwritten."""
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    masks = changes.groupBy(F.floor(F.col("pos") / 64).cast("long").alias("word_idx")).agg(F.bit_or(bit).alias("_touched"), F.bit_or(F.when(F.col("bit") == 1, bit).otherwise(F.lit(0).cast("long"))).alias("_on"))
    kept = F.col("word").bitwiseAND(F.bitwise_not(F.col("_touched"))).bitwiseOR(F.col("_on"))
    return words.join(masks, "word_idx", "left").select("word_idx", F.coalesce(kept, "word").alias("word"))


def append(words: DataFrame, length: int, value: int, width: int) -> tuple[DataFrame, int]:
    """The vector of `length` bits with `width` (0 to 64) bits of a value at its end, and its new length."""
    if not 0 <= width <= 64 or value >> width:
        raise ValueError("the value doesn't fit")
    if not width:
        return words, length
    w, s = divmod(length, 64)
    parts = [(w, value << s & (1 << 64) - 1), *([(w + 1, value >> 64 - s)] if s + width > 64 else [])]
    added = words.sparkSession.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in parts], EMPTY)
    return words.unionByName(added).groupBy("word_idx").agg(F.bit_or("word").alias("word")), length + width


def push(words: DataFrame, length: int, bit: int) -> tuple[DataFrame, int]:
    return append(words, length, bit, 1)


def extend(words: DataFrame, length: int, n: int, bit: int) -> tuple[DataFrame, int]:
    """The vector with n bits more, all zero or all one."""
    end = length + n
    every = words.sparkSession.range(-(-end // 64)).select(F.col("id").alias("word_idx"))
    filled = every.join(words, "word_idx", "left").withColumn("word", F.coalesce("word", F.lit(0).cast("long")))
    if not bit:
        return filled, end
    first = F.greatest(F.lit(0), F.lit(length) - F.col("word_idx") * 64).cast("int")
    last = F.least(F.lit(64), F.lit(end) - F.col("word_idx") * 64).cast("int")
    spread = filled.withColumn("_a", first).withColumn("_b", last)
    mask = F.expr("case when _a >= _b then 0L else shiftleft(case when _b - _a = 64 then -1L else shiftleft(1L, _b - _a) - 1L end, _a) end")
    return spread.select("word_idx", F.col("word").bitwiseOR(mask).alias("word")), end


def bits_of(words: DataFrame, length: int) -> DataFrame:
    """(pos, bit) for each bit."""
    each = words.select("word_idx", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_k"))
    return each.select((F.col("word_idx") * 64 + F.col("_k")).alias("pos"), F.expr("cast(shiftrightunsigned(word, _k) & 1 as int)").alias("bit")).where(F.col("pos") < length)


def positions_of(words: DataFrame, length: int, bit: int, start: int = 0) -> DataFrame:
    """(pos): the places from `start` on, itself included, that hold `bit`."""
    return bits_of(words, length).where((F.col("bit") == bit) & (F.col("pos") >= start)).select("pos")


def neighbours(words: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(pos, prev_one, next_one) of every set bit: the set bits strictly before and after it, null if there is none.

    In three steps: within each word, over the words of a block, and over the
    blocks' first and last set bits; only these meet in one task.
    """
    on = positions_of(words, length, 1).withColumn("_w", F.floor(F.col("pos") / 64)).withColumn("_b", F.floor(F.col("_w") / block))
    edges = F.min("pos").alias("_first"), F.max("pos").alias("_last")

    def beside(df: DataFrame, along: WindowSpec, names: tuple[str, str]) -> DataFrame:
        """The last set bit before a group and the first after it."""
        return df.withColumn(names[0], F.lag("_last").over(along)).withColumn(names[1], F.lead("_first").over(along)).drop("_first", "_last")

    of_words = beside(on.groupBy("_b", "_w").agg(*edges), Window.partitionBy("_b").orderBy("_w"), ("_p1", "_n1")).drop("_b")
    of_blocks = beside(on.groupBy("_b").agg(*edges), Window.orderBy("_b"), ("_p2", "_n2"))
    inside = Window.partitionBy("_w").orderBy("pos")
    near = on.withColumn("_p0", F.lag("pos").over(inside)).withColumn("_n0", F.lead("pos").over(inside)).join(of_words, "_w").join(of_blocks, "_b")
    return near.select("pos", F.coalesce("_p0", "_p1", "_p2").alias("prev_one"), F.coalesce("_n0", "_n1", "_n2").alias("next_one"))


def next_one(words: DataFrame, length: int, pos: int) -> int | None:
    """The least set bit strictly after pos."""
    return positions_of(words.where(F.col("word_idx") >= pos // 64), length, 1, pos + 1).agg(F.min("pos")).first()[0]


def prev_one(words: DataFrame, length: int, pos: int) -> int | None:
    """The largest set bit strictly before pos."""
    return positions_of(words.where(F.col("word_idx") <= pos // 64), length, 1).where(F.col("pos") < pos).agg(F.max("pos")).first()[0]


def count_ones(words: DataFrame) -> DataFrame:
    return words.agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("long").alias("ones"))


@dataclass(frozen=True)
class BitVector:
    """Words and the number of bits in them."""

    words: DataFrame
    length: int = 0

    @classmethod
    def new(cls, spark: SparkSession) -> BitVector:
        return cls(empty(spark))

    @classmethod
    def filled(cls, spark: SparkSession, n: int, bit: int) -> BitVector:
        return cls(ones(spark, n) if bit else zeroes(spark, n), n)

    def append(self, value: int, width: int) -> BitVector:
        return BitVector(*append(self.words, self.length, value, width))

    def push(self, bit: int) -> BitVector:
        return self.append(bit, 1)

    def extend(self, n: int, bit: int) -> BitVector:
        return BitVector(*extend(self.words, self.length, n, bit))

    def set(self, changes: DataFrame) -> BitVector:
        """Places beyond the vector raise."""
        inside = (F.col("pos") >= 0) & (F.col("pos") < self.length)
        checked = changes.withColumn("pos", F.when(inside, F.col("pos")).otherwise(F.raise_error(F.lit(f"a place is beyond the {self.length} bits")).cast("long")))
        return BitVector(set_bits(self.words, checked), self.length)

    def get(self, asked: DataFrame, at: str, width: int = 1) -> DataFrame:
        return get_bits(self.words, asked, at, width, self.length)

    def positions(self, bit: int, start: int = 0) -> DataFrame:
        return positions_of(self.words, self.length, bit, start)

    def neighbours(self) -> DataFrame:
        return neighbours(self.words, self.length)

    def next_one(self, pos: int) -> int | None:
        return next_one(self.words, self.length, pos)

    def prev_one(self, pos: int) -> int | None:
        return prev_one(self.words, self.length, pos)

    def count_ones(self) -> int:
        return count_ones(self.words).first()["ones"]

    def __len__(self) -> int:
        return self.length

    @property
    def is_empty(self) -> bool:
        return not self.length

    def metadata(self) -> DataFrame:
        """One row: length, words, ones, bytes."""
        return self.words.agg(F.lit(self.length).cast("long").alias("length"), F.count("*").alias("words"), F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("long").alias("ones"), (8 * F.count("*")).alias("bytes"))
