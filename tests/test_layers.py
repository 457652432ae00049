"""Sources, positions, bits, blocks, reports, bench and streams."""

import json

import pytest
from lexiweave.operators import bits, blocks, pairs, positions
from lexiweave.plans import bench, report
from lexiweave.plans.codecs import codec
from lexiweave.sources import results, strings
from lexiweave.streaming.encode import encode_stream
from pyspark.sql import functions as F


def write(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_json_array(spark, tmp_path):
    texts = ["a", "", "日本", 'q"\\', "a"]
    got = strings.load_json(spark, write(tmp_path / "x.json", texts)).orderBy("idx").collect()
    assert [(r["idx"], r["s"]) for r in got] == list(enumerate(texts))
    assert strings.load_json(spark, write(tmp_path / "e.json", [])).count() == 0


@pytest.mark.parametrize("bad", [["a", 1], ["a", None], [True], [{"a": "b"}], [["a"]], {"a": "b"}, '"a"', "[1", "7"], ids=str)
def test_json_that_is_no_array_of_strings(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not an array of strings"):
        strings.load_json(spark, write(tmp_path / "bad.json", bad)).collect()


def test_json_directory(spark, tmp_path):
    write(tmp_path / "a.json", ["x", "y"])
    write(tmp_path / "b.json", ["z"])
    write(tmp_path / "c.JSON", ["no"])
    write(tmp_path / "d.txt", ["no"])
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "e.json", ["no"])
    got = strings.load_json_directory(spark, str(tmp_path)).collect()
    assert {(r["dataset_name"], r["idx"], r["s"]) for r in got} == {("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")}


ROW = ("d", "c", 1.5, 2.0, 3.0, 4)


def test_results(spark, tmp_path):
    path = str(tmp_path / "r")
    assert results.read_results(spark, path).count() == 0
    results.append_results(spark.createDataFrame([ROW], results.SCHEMA), path)
    results.append_results(spark.createDataFrame([ROW], results.SCHEMA), path)
    assert [tuple(r) for r in results.read_results(spark, path).collect()] == [ROW, ROW]
    out = str(tmp_path / "r.json")
    results.export_results(results.read_results(spark, path), out)
    assert len(json.load(open(out))) == 2
    assert [tuple(r) for r in results.read_results(spark, out).collect()] == [ROW, ROW]
    results.reset_results(spark, path)
    assert results.read_results(spark, path).count() == 0


@pytest.mark.parametrize("name", ["r.json", "r"])
def test_results_that_cannot_be_parsed(spark, tmp_path, capsys, name):
    write(tmp_path / name, "[{\"dataset_name\": \"d\"" if name == "r.json" else "{\"dataset_name\": \n nothing")
    got = results.read_results(spark, str(tmp_path / name))
    assert got.collect() == [] and got.columns == results.SCHEMA.names
    assert "can't be parsed" in capsys.readouterr().err


def test_positions_over_many_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), F.expr("repeat('é', cast(id % 5 as int))").alias("s"))
    got = [tuple(r) for r in positions.running_sum(df.withColumn("n", F.octet_length("s")), "n", "end", block=64).orderBy("idx").select("idx", "end").collect()]
    total, want = 0, []
    for i in range(1000):
        total += 2 * (i % 5)
        want.append((i, total))
    assert got == want


def test_pair_counts_overlap(spark):
    s = spark.createDataFrame([(0, "aaa"), (1, "aaa"), (2, "b"), (3, "")], "idx long, s string")
    assert [tuple(r) for r in pairs.top_pairs(s, 5).collect()] == [(97, 97, 4)]
    _, merges = pairs.merge_rounds(s, 5)
    assert merges == [(256, 97, 97, 4), (257, 256, 97, 2)]


def vector(spark, positions_set, length):
    return bits.set_bits(bits.zeroes(spark, length), spark.createDataFrame([(p, 1) for p in positions_set], "pos long, bit int"))


def test_bit_search(spark):
    v = vector(spark, [0, 63, 64, 130], 140)
    assert [bits.next_one(v, 140, p) for p in (0, 63, 64, 130)] == [63, 64, 130, None]
    assert [bits.prev_one(v, 140, p) for p in (64, 63, 0)] == [63, 0, None]
    assert [tuple(r) for r in bits.neighbours(v, 140).orderBy("pos").collect()] == [(0, None, 63), (63, 0, 64), (64, 63, 130), (130, 64, None)]
    assert bits.count_ones(v).first()["ones"] == 4
    assert bits.positions_of(v, 140, 0, 60).count() == 77


def test_pack(spark):
    def words(values):
        return [r["word"] for r in bits.pack(spark.createDataFrame(list(enumerate(values)), "pos long, value long"), 13).orderBy("word_idx").collect()]

    assert words([256, 97]) == [794880]
    assert words([1, 2, 3, 4, 8191, 0, 300, 97]) == [-4501400402771967, 13024034817]
    with pytest.raises(Exception, match="more than 13 bits"):
        words([8192])


@pytest.mark.parametrize("width", [1, 7, 13, 32, 63, 64])
def test_bits_as_integers(spark, width):
    values = [(i * 0x9E3779B97F4A7C15) % (1 << width) for i in range(30)]
    v, length, want = bits.empty(spark), 0, 0
    for x in values[:6]:
        v, length = bits.append(v, length, x, width)
        want |= x << (length - width)
    v = v.persist()
    whole = sum((r["word"] % (1 << 64)) << (64 * r["word_idx"]) for r in v.collect())
    assert (whole, length) == (want, 6 * width)
    asked = spark.createDataFrame([(i * width,) for i in range(7)], "at long")
    got = [r["value"] for r in bits.get_bits(v, asked, "at", width, length).orderBy("at").collect()]
    assert [None if x is None else x % (1 << 64) for x in got] == [*values[:6], None]
    assert bits.get_bits(v, asked.limit(1), "at", 65, length).first()["value"] is None
    assert bits.get_bits(v, asked.limit(1), "at", 0, length).first()["value"] == 0


def test_extend(spark):
    v, n = bits.extend(bits.ones(spark, 70), 70, 130, 1)
    assert n == 200 and [r["bit"] for r in bits.bits_of(v, 256).orderBy("pos").collect()] == [1] * 200 + [0] * 56
    v, n = bits.push(bits.ones(spark, 64), 64, 1)
    assert n == 65 and bits.count_ones(v).first()["ones"] == 65


def test_neighbours_over_many_blocks(spark):
    places = [0, 5, 64, 700, 701, 5000, 5100, 9_999]
    v = vector(spark, places, 10_000)
    got = [tuple(r) for r in bits.neighbours(v, 10_000, block=3).orderBy("pos").collect()]
    assert got == [(p, a, b) for p, a, b in zip(places, [None, *places], [*places[1:], None])]


def test_a_vector_carries_its_length(spark):
    v = bits.BitVector.new(spark)
    assert v.is_empty and len(v) == 0
    v = v.append(0b1011, 7).push(1).extend(130, 1).extend(5, 0)
    assert len(v) == 143 and not v.is_empty and v.count_ones() == 3 + 1 + 130
    assert v.metadata().first().asDict() == {"length": 143, "words": 3, "ones": 134, "bytes": 24}
    assert (v.next_one(3), v.prev_one(7)) == (7, 3)
    asked = spark.createDataFrame([(0,), (7,), (142,), (143,), (-1,)], "at long")
    assert [r["value"] for r in v.get(asked, "at").orderBy("at").collect()] == [None, 1, 1, 0, None]
    v = v.set(spark.createDataFrame([(0, 0), (142, 1)], "pos long, bit int"))
    assert v.positions(1, 138).count() == 1 and v.neighbours().count() == 134
    with pytest.raises(Exception, match="beyond the 143 bits"):
        v.set(spark.createDataFrame([(143, 1)], "pos long, bit int")).count_ones()
    assert bits.BitVector.filled(spark, 70, 1).count_ones() == 70 and bits.BitVector.filled(spark, 70, 0).count_ones() == 0


SIZES = [5, 1, 3, 1, 6, 2]


def test_blocks(spark):
    items = spark.createDataFrame(list(enumerate(SIZES)), "idx long, size long")
    assigned = blocks.assign(items, 4).persist()
    assert [r["block_id"] for r in assigned.orderBy("idx").collect()] == [1, 2, 2, 3, 4, 5]
    meta = blocks.metadata(assigned).orderBy("block_id").collect()
    assert [r["uncompressed_size"] for r in meta] == [0, 5, 4, 1, 6, 2]
    assert [r["num_items_psum"] for r in meta] == [0, 1, 3, 4, 5, 6]
    asked = spark.createDataFrame([(i, i) for i in range(6)], "qid long, idx long")
    assert [r["block_id"] for r in blocks.block_of(blocks.metadata(assigned), asked).orderBy("qid").collect()] == [1, 2, 2, 3, 4, 5]
    assert [r["offset"] for r in blocks.offsets(assigned).orderBy("idx").collect()] == [0, 0, 1, 0, 0, 0]


@pytest.mark.parametrize("block_size, segment", [(4, 2), (4, 4), (10, 3), (1000, 2), (25, 7), (1, 1)])
def test_blocks_do_not_depend_on_segments(spark, block_size, segment):
    sizes = SIZES + [0, 0, 9, 0, 30, 0, 2] + [(i * 7) % 13 for i in range(60)]
    items = spark.createDataFrame(list(enumerate(sizes)), "idx long, size long").repartition(3)
    block, held, want = 0, 0, []
    for size in sizes:
        if held + size > block_size:
            block, held = block + 1, 0
        held += size
        want.append(block)
    for seg in (segment, None):
        assert [r["block_id"] for r in blocks.assign(items, block_size, seg).orderBy("idx").collect()] == want
    assigned = blocks.assign(items, block_size, segment)
    asked = spark.createDataFrame([(i, i) for i in range(len(sizes))], "qid long, idx long")
    assert [r["block_id"] for r in blocks.block_of(blocks.metadata(assigned), asked, width=5).orderBy("qid").collect()] == want
    assert blocks.assign(items.limit(0), block_size, segment).count() == 0


def test_queries_find_their_block_by_equality(spark):
    items = spark.range(1000).select(F.col("id").alias("idx"), F.lit(3).cast("long").alias("size"))
    plan = blocks.block_of(blocks.metadata(blocks.assign(items, 100)), spark.range(5).select(F.col("id").alias("qid"), F.col("id").alias("idx")))
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()


def test_block_cache(spark):
    texts = [f"text {i}" for i in range(40)]
    s = spark.createDataFrame(list(enumerate(texts)), "idx long, s string")
    assigned = blocks.assign(s.select("idx", F.octet_length("s").alias("size")), 30)
    cache = blocks.BlockCache(blocks.compress(s, assigned), assigned)
    block = {r["idx"]: r["block_id"] for r in assigned.collect()}
    assert cache.get(block[7], 7) == "text 7" and cache.get(block[7], 30) is None and cache.get(10_000, 0) is None
    held = cache.held[block[7]]
    assert {r["s"] for r in cache.load(block[7], block[30]).collect()} == {t for i, t in enumerate(texts) if block[i] in (block[7], block[30])}
    assert cache.held[block[7]] is held and held.is_cached
    cache.drop()
    assert not cache.held and not held.is_cached


def test_report(spark):
    rows = [("d1", "A", 2.0, 1.0, 1.0, 3), ("d1", "A", 4.0, 1.0, 1.0, 4), ("d2", "A", 5.0, 1.0, 1.0, 10)]
    r = spark.createDataFrame(rows, results.SCHEMA)
    assert {(x["dataset_name"], x["compression_rate"], x["average_random_access_time"]) for x in report.by_dataset(r).collect()} == {("d1", 3.0, 3), ("d2", 5.0, 10)}
    top = report.overall(r).first()
    assert (top["compression_rate"], top["average_random_access_time"]) == (4.0, 6)
    assert [x["dataset_name"] for x in report.report(r).collect()] == ["d1", "d2", "AVERAGE"]
    assert "AVERAGE" in report.print_report(r)


def test_measure_and_suite(spark, tmp_path):
    texts = [f"user_{i % 50}" for i in range(200)]
    write(tmp_path / "users.json", texts)
    write(tmp_path / "broken.json", [1])
    got = bench.suite(spark, str(tmp_path), str(tmp_path / "out"), codecs=("raw", "pairs"), runs=2, queries=50).collect()
    assert sorted(r["compressor_name"] for r in got) == ["Pairs", "Pairs", "Raw", "Raw"]
    assert {r["compression_rate"] for r in got if r["compressor_name"] == "Raw"} == {1.0}
    assert bench.random_queries(spark, 0, 5).count() == 0
    assert all(0 <= r["idx"] < 7 for r in bench.random_queries(spark, 7, 100).collect())


@pytest.mark.parametrize("args, message", [
    (["one", "{t}/none.json", "raw", "out"], "doesn't exist"), (["one", "{t}", "raw", "out"], "isn't a file"), (["one", "{t}/a.json", "raw", "out", "-1"], "isn't a core's number"),
    (["suite", "{t}/none", "out"], "doesn't exist"), (["suite", "{t}/a.json", "out"], "isn't a directory"), (["suite", "{t}", "out", "--codecs", "raw,zip"], "unknown codec 'zip'"),
])
def test_wrong_arguments_end_before_spark_starts(tmp_path, capsys, monkeypatch, args, message):
    write(tmp_path / "a.json", ["x"])
    monkeypatch.setattr(bench, "SparkSession", None)
    # a negative number would be taken for an option
    args = [a.format(t=tmp_path) for a in args]
    assert bench.main([*args[:-1], "--", args[-1]] if args[-1] == "-1" else args) == 1
    assert message in capsys.readouterr().err


@pytest.mark.parametrize("args", [["one", "x.json", "zip", "out"], ["one", "x.json", "raw", "out", "first"], ["one"], []])
def test_arguments_that_cannot_be_read(args, capsys):
    with pytest.raises(SystemExit) as stop:
        bench.main(args)
    assert stop.value.code == 2 and "usage" in capsys.readouterr().err


def test_pinning(monkeypatch, capsys):
    held = []
    monkeypatch.setattr(bench.os, "sched_setaffinity", lambda pid, cores: held.append((pid, cores)))
    bench.pin(3)
    assert held == [(0, {3})]

    def fails(pid, cores):
        raise OSError("no such core")

    monkeypatch.setattr(bench.os, "sched_setaffinity", fails)
    bench.pin(10_000)
    assert "not pinned to core 10000" in capsys.readouterr().err


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "a.json", [f"user_{i % 9}" for i in range(40)])
    assert bench.main(["one", str(tmp_path / "a.json"), "pairs", str(tmp_path / "out"), "--queries", "20"]) == 0
    row = results.read_results(spark, str(tmp_path / "out")).first()
    assert (row["dataset_name"], row["compressor_name"]) == ("a", "Pairs")


def test_stream(spark, tmp_path):
    s = spark.createDataFrame([(i, f"user_{i % 9}") for i in range(40)], "idx long, s string")
    model = codec("pairs").fit(s)
    s.write.parquet(str(tmp_path / "in"))
    encode_stream(spark.readStream.schema("idx long, s string").parquet(str(tmp_path / "in")), model, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    back = model.decode(spark.read.parquet(str(tmp_path / "out")))
    assert bench.mismatches(s, back) == 0
