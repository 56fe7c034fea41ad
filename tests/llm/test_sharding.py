import random
import zlib

from tabwright.llm import sharding as sd

from tests.llm import samples


def check(rows, got, shards):
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == sorted(str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t in rows)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(shards):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * largest


def test_law_slots_and_hot_texts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(samples.words(rng, rng.randrange(1, 120)))) for k in range(900)]
    rows += [(10_000 + k, "one text that a third of all rows share " * 4) for k in range(600)]
    got = sd.assign(samples.corpus(spark, rows).repartition(5), 12).collect()
    check(rows, got, 12)
    # The order is that of the texts, so few groups are cut.
    spread = {}
    for r in got:
        spread.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in spread.values()) <= 11


def test_same_result_for_any_partitioning(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(samples.words(rng, rng.randrange(1, 60)))) for k in range(300)]
    results = [sorted(map(tuple, sd.assign(samples.corpus(spark, rows).repartition(n), 7).collect())) for n in (1, 9)]
    assert results[0] == results[1]


def test_overfull_ranges_are_subdivided(spark):
    records = sd.counted(sd.keyed(samples.corpus(spark, [(k, "same") for k in range(2000)] + [(5000, "x" * 40_000)])))
    splitters, weights = sd.split(records.cache(), 4)
    fair = sum(b for b, _ in weights.values()) / (4 * sd.RANGES)
    crowded = [b for b, n in weights.values() if n > 1 and b > sd.OVERFULL * fair + 40_016]
    assert not crowded and splitters == sorted(set(splitters)) and sum(n for _, n in weights.values()) == 2001


def test_odd_rows_and_empty_tables(spark):
    rows = [(r[0], r[1]) for r in samples.odd_rows()]
    check(rows, sd.assign(samples.odd(spark), 3).collect(), 3)
    same = [(1, "x")] * 50
    check(same, sd.assign(samples.corpus(spark, same), 5).collect(), 5)
    assert sd.assign(samples.empty(spark)).count() == 0


def test_copies_of_one_record_are_numbered_in_runs(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, " ".join(samples.words(rng, rng.randrange(1, 60)))) for k in range(200)]
    rows += [(None, None)] * 500 + [(3, "often")] * 64 + [(4, "often")] * 65
    whole = sorted(map(str, sd.assign(samples.corpus(spark, rows), 9).collect()))
    monkeypatch.setattr(sd, "RUN", 64)
    got = sd.assign(samples.corpus(spark, rows).repartition(7), 9).collect()
    check(rows, got, 9)
    assert sorted(map(str, got)) == whole
    # No window sees a copy, and no task numbers more than a run of them.
    records = sd.counted(sd.keyed(samples.corpus(spark, rows)))
    assert records.count() == 203 and records.agg({"copies": "sum"}).first()[0] == len(rows)
    copies = sd.numbered(records.filter("copies > 64")).groupBy("doc_id", "run").count().collect()
    assert max(r["count"] for r in copies) == 64 and sum(r["count"] for r in copies) == 565


def test_write(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(samples.words(rng, rng.randrange(1, 60)))) for k in range(400)]
    sd.write_shards(samples.corpus(spark, rows), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    sizes = [r.s for r in back.selectExpr("shard", "octet_length(text) + 16 as b").groupBy("shard").sum("b").toDF("shard", "s").collect()]
    assert len(sizes) == 5 and max(sizes) < 1.3 * min(sizes)
