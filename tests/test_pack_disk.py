"""What the pack job leaves on disk, and that a batch done by slices of its orders comes out as a whole."""

import os
import random
import time

from hortus import session
from hortus.operators.jobs import packs as PK
from tests import sequential as SEQ
from tests.test_edge_cases import PACK_SCHEMA, build, order, sp, ts


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    assert len(session.written(spark.range(1000).selectExpr("id % 7 k").groupBy("k").count()).collect()) == 7
    for _ in range(50):  # they go in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before


def _tables(spark):
    top = session.checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(top) if x.startswith("table-")}


def test_slices_of_orders_come_out_as_the_whole(spark, monkeypatch):
    rnd = random.Random(23)
    status = {i: rnd.choice([0, 0, 1]) for i in range(1, 30)}
    ordered = {(o, k): rnd.randint(1, 12) for o in status for k in rnd.sample(range(1, 7), 4)}
    packs, contents, packed = {o: {1} for o in status if not status[o]}, set(), {}
    for o, k in ordered:
        if o in packs and rnd.random() < 0.3:
            contents.add((o, 1, k))
            packed[(o, k)] = 1
    reqs = []
    for n in range(600):
        handle = rnd.choice([None, "h1", "h2", "h3"])
        reqs.append((ts(n), n, 1 if n % 5 == 0 else rnd.randint(1, 31), None if handle else rnd.choice([1, 2]), handle, rnd.randint(1, 7), rnd.randint(0, 6)))
    nulls = [(ts(700), 700, None, None, "h1", 1, 1), (ts(701), 701, 1, None, "h1", None, 1)]
    t = build(spark, species=[sp(k, 0) for k in range(1, 8)], orders=[order(o, "A", open_=s) for o, s in status.items()],
              order_lines=[(o, k, q) for (o, k), q in ordered.items()], packs=[(o, 1) for o in packs],
              pack_contents=[(o, p, k, 1) for o, p, k in contents])
    monkeypatch.setattr(PK, "SLICE_ROWS", 200)
    before = _tables(spark)
    res = PK.allocate_packs(t, spark.createDataFrame(reqs + nulls, PACK_SCHEMA))
    assert len(_tables(spark) - before) <= 1 + 2 * PK.MOST_SLICES  # the batch; what became of a slice, its packs
    rows = res.outcomes.collect()
    got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["pack_number"]) for r in rows}
    assert len(rows) == len(got) == 602
    assert [got.pop((x[0], x[1]))[1] for x in nulls] == ["INVALID", "INVALID"]
    cols = ["ts", "seq", "ordine", "pacco", "new_pack", "specie_di_pianta", "quantita"]
    want, _ = SEQ.replay_packs(status, ordered, packed, packs, contents, [dict(zip(cols, r)) for r in reqs])
    assert got == want
    new = res.tables["pack_contents"].collect()
    assert len(new) == len(contents) + sum(v[0] == "accepted" for v in want.values())
