"""Codecs: fit on strings, then encode, decode, look up and account for space.

    model = codec("pairs16").fit(strings)        # strings: idx, s
    encoded = model.encode(strings)              # idx, tokens
    model.decode(encoded); model.lookup(encoded, queries); model.space_used(encoded)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.bytes import merge_threshold
from lexiweave.operators import bits, decode, parse, train
from lexiweave.operators.positions import token_positions


def data_bytes(strings: DataFrame) -> int:
    return strings.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).cast("long")).first()[0]


class Model:
    """What a codec learned: its dictionary, in id order, and its rows (token_id, token, token_len, left_id, right_id, freq)."""

    def __init__(self, codec: Codec, dictionary: DataFrame | None):
        self.codec = codec
        if dictionary is not None:
            rows = dictionary.orderBy("token_id").collect()
            self.dictionary = dictionary.sparkSession.createDataFrame(rows, train.DICTIONARY)
            self.tokens = [bytes(r["token"]) for r in rows]
            self.merges = [(r["token_id"], r["left_id"], r["right_id"]) for r in rows if r["left_id"] is not None]

    def encode(self, strings: DataFrame) -> DataFrame:
        """(idx, tokens)."""
        if self.codec.kind == "bpe":
            return parse.replay(strings, self.merges)
        return parse.parse(strings, self.tokens)

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(idx, s)."""
        return decode.decode_arrow(encoded, self.tokens)

    def lookup(self, encoded: DataFrame, queries: DataFrame) -> DataFrame:
        """(qid, idx, s) for queries (qid, idx)."""
        return decode.lookup(encoded, self.tokens, queries)

    def space_used(self, encoded: DataFrame) -> DataFrame:
        """One row: stream_bytes, dictionary_bytes, space_bytes (the offsets of strings left out), space_with_offsets_bytes (8 bytes for each)."""
        total = encoded.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("n"), F.count("*").alias("rows"))
        stream = F.floor(F.col("n") * self.codec.bits / 8).cast("long")
        dictionary = sum(map(len, self.tokens)) + 4 * (len(self.tokens) + 1)
        return total.select(stream.alias("stream_bytes"), F.lit(dictionary).cast("long").alias("dictionary_bytes"), (stream + dictionary).alias("space_bytes"), (stream + dictionary + 8 * (F.col("rows") + 1)).alias("space_with_offsets_bytes"))

    def pack(self, encoded: DataFrame) -> DataFrame:
        """All tokens in order as words of bits (word_idx, word)."""
        starts = token_positions(encoded).select("idx", "start_token")
        each = encoded.join(starts, "idx").select("start_token", F.posexplode("tokens").alias("k", "value")).select((F.col("start_token") + F.col("k")).alias("pos"), "value")
        return bits.pack(each, self.codec.bits)

    def unpack(self, words: DataFrame, boundaries: DataFrame) -> DataFrame:
        """(idx, tokens) from packed words and boundaries (idx, n_tokens, start_token, end_token)."""
        each = boundaries.where("n_tokens > 0").select("idx", F.explode(F.sequence("start_token", F.col("end_token") - 1)).alias("pos"))
        values = bits.unpack(words, self.codec.bits, each)
        lists = values.groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"].cast("int")).alias("tokens"))
        return boundaries.select("idx").join(lists, "idx", "left").select("idx", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))

    def encode_literal(self, value: str) -> list[int]:
        """Tokens of one string: the same string has the same tokens, so equality may be tested on them."""
        if self.codec.kind == "bpe":
            return self.encode(self.dictionary.sparkSession.createDataFrame([(0, value)], "idx long, s string")).first()["tokens"]
        return train.Matcher(self.tokens).parse(value.encode())


class RawModel(Model):
    """Strings as they are: encoded (idx, s)."""

    def __init__(self, codec: Codec):
        super().__init__(codec, None)

    def encode(self, strings: DataFrame) -> DataFrame:
        return strings.select("idx", "s")

    def decode(self, encoded: DataFrame) -> DataFrame:
        return encoded.select("idx", "s")

    def lookup(self, encoded: DataFrame, queries: DataFrame) -> DataFrame:
        return queries.join(encoded, "idx").select("qid", "idx", "s")

    def space_used(self, encoded: DataFrame) -> DataFrame:
        n = encoded.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).cast("long").alias("n"), F.count("*").alias("rows"))
        return n.select(F.col("n").alias("stream_bytes"), F.lit(0).cast("long").alias("dictionary_bytes"), F.col("n").alias("space_bytes"), (F.col("n") + 8 * (F.col("rows") + 1)).alias("space_with_offsets_bytes"))


@dataclass(frozen=True)
class Codec:
    """A codec and its parameters.

    kind: raw, bpe or online. bits: width of an id in the stream; ids are fewer
    than max_tokens. max_len: longest token of an online dictionary. seed: order
    of the online pass (None: order of idx). threshold: pair count at which the
    online pass merges, by default from the size of the strings. min_freq: least
    pair count that byte-pair encoding merges. first_bytes: strings that the online
    pass is first tried on; the dictionary doesn't depend on it.
    """

    name: str
    label: str
    kind: str
    bits: int = 16
    max_tokens: int = 1 << 16
    max_len: int | None = None
    seed: int | None = 42
    threshold: int | None = None
    min_freq: int = 1
    first_bytes: int = train.FIRST_BYTES

    def fit(self, strings: DataFrame) -> Model:
        if self.kind == "raw":
            return RawModel(self)
        if self.kind == "bpe":
            return Model(self, train.bpe_dictionary(strings, self.max_tokens, self.min_freq))
        threshold = self.threshold
        if threshold is None:
            threshold = strings.agg(merge_threshold(F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).cast("double"))).first()[0]
        return Model(self, train.online_dictionary(strings, threshold, self.max_tokens, self.max_len, self.seed, self.first_bytes))


#: By name: the identity; byte-pair encoding; the online pass with 16-bit ids, with tokens of 16 bytes at most, and with packed 13-bit ids.
CODECS = {c.name: c for c in (
    Codec("raw", "Raw", "raw"),
    Codec("bpe", "BPE", "bpe"),
    Codec("pairs", "Pairs", "online"),
    Codec("pairs16", "Pairs16", "online", max_len=16),
    Codec("pairs13", "Pairs13", "online", bits=13, max_tokens=1 << 13),
)}


def codec(name: str, **changes) -> Codec:
    """A codec by name, with some parameters changed."""
    if name not in CODECS:
        raise ValueError(f"unknown codec {name!r}; there are {', '.join(CODECS)}")
    return replace(CODECS[name], **changes)
