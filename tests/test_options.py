import pytest

from keyloom.operators.compare import compare, selected, tune
from keyloom.plans.options import parse
from keyloom.plans.planner import Config


def test_options():
    o = parse(["--mode=sorted,reverse", "records=1k,2k", "key-order=signed", "config=11,12,64", "tupleBits=8", "algos=records"])
    assert o.modes == ("SORTED", "REVERSE") and o.records == (1000, 2000) and o.signed and (o.config.msd_bits, o.config.tiny, o.config.tuple_bits) == (11, 64, 8)
    assert parse(["RANDOM", "10k", "11", "12", "32"]).config.msd_bits == 11
    assert len(parse(["sweep=true"]).cases()) == 65
    o = parse(["threads=6", "staggerTuples=false", "localMsd=no", "dominantCore=0", "heapScratch=5k", "workStealing=false", "workBatch=3", "tuneRecords=1m", "curated=true", "localMsdMinRecords=9", "msd=12"])
    assert (o.partitions, o.stealing, o.work_batch, o.tune_records, o.algorithms) == (6, False, 3, 1_000_000, ("curated",))
    assert (o.config.stagger, o.config.local, o.config.core, o.config.heap_rows, o.config.local_min_rows, o.config.msd_bits) == (False, False, False, 5000, 9, 12)
    assert parse(["threads=auto"]).partitions == 0 and selected(("curated",)) == ["total_order", "positions", "adaptive"]
    for bad in (["lsdHeapUnroll=4"], ["what=1"], ["mode=nope"], ["runs=0"], ["config=99,1,1"]):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        selected(("nope",))


def test_harness_skips_and_fails_in_rows(spark, monkeypatch):
    from keyloom.operators import compare as c

    monkeypatch.setitem(c.STRATEGIES, "one_task", (*c.STRATEGIES["one_task"][:2], 100))
    monkeypatch.setitem(c.STRATEGIES, "keys", ("keys", lambda df, o: 1 / 0, None))
    rows = {r.algorithm: r for r in compare(spark, parse(["records=200", "runs=1", "warmups=0", "algos=one_task,keys,no_radix,dispatch,adaptive", "prescan=false"])).collect()}
    assert rows["one_task"].error.startswith("skipped") and "ZeroDivision" in rows["keys"].error
    assert all(rows[k].error is None for k in ("no_radix", "dispatch", "adaptive"))


def test_harness(spark):
    rows = compare(spark, parse(["mode=few-unique-values,empty", "records=300", "runs=1", "warmups=0", "algos=keys,positions"])).collect()
    assert len(rows) == 4 and all(r.error is None and r.median > 0 for r in rows)
    assert tune(spark, "RANDOM", 100, [Config(), Config(msd_bits=4)], 1) in (Config(), Config(msd_bits=4))
