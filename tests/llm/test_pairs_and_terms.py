"""Hard negatives, covering SimHash and the divergence audit against brute force, SQL, edge cases and empty tables."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash

from hortus.llm import divergence, hard_negatives, minhash, mixing, queries, simhash, suffixes

SF = "/root/testdata/sf0.001"


def duck(df, name, sql):
    """The rows of ``sql`` over ``df`` as table ``name``."""
    con = duckdb.connect()
    con.register(name, df.toArrow())
    return Counter(con.execute(sql).fetchall())


def got(df, sql_columns):
    return Counter(tuple(r[c] for c in sql_columns) for r in df.collect())


# ---- 11 hard negatives

PAIR = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
VECTORS = "vec_id long, embedding array<float>, label int, grp string, floor long"


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + 0.2 * rng.normal(size=dims)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(4)), "x", 1))
    return out


@pytest.mark.parametrize("dims, blocks", [(8, 16), (3, 4), (33, 64)])
def test_hard_negatives_match_sql(spark, monkeypatch, dims, blocks):
    monkeypatch.setattr(hard_negatives, "ROWS", blocks)
    monkeypatch.setattr(hard_negatives, "SHELF", 3)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    rows = clustered(700, dims, dims)
    rows += [(2000 + i, rows[7][1], i % 3, "x", 1) for i in range(90)]  # one very common vector, ties by id
    df = spark.createDataFrame(rows, VECTORS)
    moved = df.selectExpr("vec_id", "embedding", "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label", "grp", "floor")
    assert got(hard_negatives.hard_negatives(moved), PAIR) == duck(df, "embeddings", hard_negatives.SQL)


def test_registered_hard_negatives_match_sql(spark):
    df = queries.op11_hard_negatives(spark, SF)
    assert got(df, PAIR) == duck(spark.read.parquet(f"{SF}/embeddings.parquet"), "embeddings", queries.ORACLES["op11_hard_negatives"])


def test_unsound_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = clustered(40, 4, 5)
    bad = [(100, None, 1, "x", 1), (101, [0.1, None, 0.2, 0.3], 1, "x", 1), (102, [nan, 0.1, 0.1, 0.1], 2, "x", 1),
           (103, [inf, 0.1, 0.1, 0.1], 2, "x", 1), (104, [0.5] * 4, None, "x", 1), (None, [0.5] * 4, 1, "x", 1)]
    whole = hard_negatives.hard_negatives(spark.createDataFrame(good + bad, VECTORS), every=5)
    assert got(whole, PAIR) == got(hard_negatives.hard_negatives(spark.createDataFrame(good, VECTORS), every=5), PAIR)
    # Repeated rows count once; the order of the rows does not matter.
    again = hard_negatives.hard_negatives(spark.createDataFrame(good[::-1] + good[:9], VECTORS), every=5)
    assert got(again, PAIR) == got(whole, PAIR)


def test_odd_vectors(spark):
    rows = [(0, [], 1, "x", 1), (1, [3e38, -3e38], 1, "x", 1), (2, [1.0], 1, "x", 1), (3, [1.0, 2.0, 3.0], 2, "x", 1)]
    df = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), every=1)
    assert all(80 * r.positive_score <= 100 * r.negative_score <= 100 * r.positive_score for r in df.collect())
    for empty in ([], [(0, None, None, None, None)], [(0, [], 1, "x", 1)]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(empty, VECTORS)).count() == 0


@pytest.mark.parametrize("dims", [2, 3, 5])
def test_hilbert_neighbours_differ_by_one_step(dims):
    cells = np.array(list(itertools.product(range(4), repeat=dims)))
    keys = hard_negatives.hilbert_keys(cells, 2)
    walk = cells[np.argsort(np.array(keys, object))]
    assert len(set(keys)) == len(cells)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_prune(spark):
    rows = clustered(600, 4, 9)
    src = spark.createDataFrame([(r[0], r[2], r[1]) for r in rows], "vec_id long, label long, vec array<double>")
    stored = hard_negatives.blocks(src, 4, 100).toPandas()
    assert sorted(i for ids in stored["ids"] for i in ids) == list(range(600))
    import pandas as pd
    v = {i: hard_negatives._matrix([raw], 4)[j] for ids, raw in zip(stored["ids"], stored["v"], strict=True) for j, i in enumerate(ids)}
    a = np.stack([v[i] for i in range(0, 600, 100)])
    anchors = pd.DataFrame({"label": [1] * 6, "floor": [1 << 40] * 6})
    assert not hard_negatives._needed(a, anchors, stored, False).any()  # no product reaches that floor
    for lo, hi, raw in zip(stored["lo"], stored["hi"], stored["v"], strict=True):
        part = hard_negatives._matrix([raw], 4)
        assert (part >= np.array(lo)).all() and (part <= np.array(hi)).all()


# ---- 12 SimHash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes):
    """{fingerprint: smallest id} over all pairs of fingerprints, from {fingerprint: smallest id of its own}."""
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for f, i in nodes.items():
        least[find(f)] = min(i, least.get(find(f), i))
    return {f: least[find(f)] for f in nodes}


def brute_simhash(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    nodes = {}
    for d, f in prints:
        if d is not None:
            nodes[f] = min(d, nodes.get(f, d))
    comp = brute_components(nodes)
    return Counter((d, f"{f:016x}", None if d is None else comp[f]) for d, f in prints)


def test_simhash_matches_brute_force(spark, edge, small):
    for df in (edge, small):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = simhash.near_duplicates(df)
        assert out.columns == ["doc_id", "fingerprint", "component_id"]
        assert Counter(map(tuple, out.collect())) == brute_simhash(rows)


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_radius(radius):
    masks = simhash.masks(radius)
    assert len(set(masks)) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & diff == 0 for m in masks)
        mask = rng.choice(masks)
        while diff & mask:  # a pair within the mask's bucket
            diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & diff == 0 and m & mask == mask for m in simhash.finer(mask, radius))


@pytest.mark.parametrize("bucket", [150, 1024])
def test_links_of_a_dense_ball_survive_splitting(spark, bucket):
    """Thousands of links among the fingerprints near one, chains at just 4 bits, and pairs just beyond the radius."""
    rng = random.Random(bucket)
    centre = rng.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)}
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    apart = [chain[0] ^ 0b11111 << 20, *(rng.getrandbits(64) for _ in range(200)), 0, (1 << 64) - 1]
    fps = ball | set(chain) | set(apart)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in simhash.linked(df, 4, bucket).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        root[find(a)] = find(b)
    want = brute_components({f: f for f in fps})
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    brute = {}
    for f in fps:
        brute.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


# ---- 13 divergence

AUDIT = ("lang", "source", "part", "item", "value", "rank")


def test_divergence_matches_sql(spark, small, edge):
    for df in (small, edge):
        assert got(divergence.divergence(df), AUDIT) == duck(df, "documents", divergence.SQL)


def test_divergence_of_skewed_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "TERMS", 7)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("Ab", "é", "zz", "漢字") for b in ("", "x", "yé", "ab")]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))) + " 12-3_4", rng.choice(["en", "fr", None, ""]),
             rng.choice(["hot"] * 9 + ["a", "b", "é", None, "Z"]), 1, "x", 1, 2) for i in range(600)]
    rows += [(900, None, "xx", "one", 1, "x", 1, 2), (901, "!!", "xx", "two", 1, "x", 1, 2), (902, "alone", "yy", None, 1, "x", 1, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, ord long"
    df = spark.createDataFrame(rows + rows[:40], schema)
    src = df.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text")
    whole = got(divergence.divergence(df), AUDIT)
    assert whole == duck(df, "documents", divergence.SQL)
    assert {r[2] for r in whole} == {"pair", "term"} and any(r[0] == "xx" for r in whole)
    # More than one parcel of transducers gives the same counts.
    machines = divergence.vocabulary(src.select("lang", "text")).cache()
    assert machines.count() > 3
    one, many = (sorted(map(tuple, divergence.counts_by_place(src, machines, n).collect())) for n in (1 << 20, 1))
    assert one == many and one


def test_divergence_empty(empty):
    assert divergence.divergence(empty).count() == 0


def test_transducer_is_minimal_and_keeps_the_order():
    terms = sorted({"a", "ab", "abc", "tap", "taps", "top", "tops", "é", "éa", "漢", "漢字"}, key=str.encode)
    raw = [t.encode() for t in terms]
    machine = divergence.Transducer.unpacked(divergence.Transducer.of(raw).packed())
    assert list(machine.terms()) == raw
    # tap, taps, top, tops share their ends: t, then a or o, into one state.
    small = divergence.Transducer.of([b"tap", b"taps", b"top", b"tops"])
    assert small.final.size == 5
    buffer, start, end = b"", [], []
    for w in [*raw, b"ta", b"b", b"abcd", b"zzz", raw[3]]:
        start.append(len(buffer))
        buffer += w + b" "
        end.append(len(buffer) - 1)
    places = machine.places(np.frombuffer(buffer, np.uint8), np.array(start), np.array(end))
    assert places.tolist() == [*range(len(raw)), -1, -1, -1, -1, 3]
    assert divergence.Transducer.of([]).places(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


# ---- 7 near duplicates

def family(members, outliers, seed):
    """Texts of 150 words about one base, few and many of whose words are changed in ways that others share."""
    rng, base = random.Random(seed), [f"b{i}" for i in range(150)]
    rows = [" ".join(base)]
    for i in range(1, members + outliers):
        words = list(base)
        for k in rng.sample(range(5, 145, 5), 1 if i < members else 5) + [149] * (i >= members):
            words[k] = f"new{rng.randrange(3)}x{k}"
        rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_outliers_of_a_family_are_not_tested_against_all_its_members(spark, monkeypatch):
    rows, counts = family(120, 40, 5), Counter()
    wrote = minhash.materialise

    def counted(df, name):
        out = wrote(df, name)
        counts[name] += out.count()
        return out
    monkeypatch.setattr(minhash, "materialise", counted)
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, root = {d: set(minhash.shingles(t).tolist()) for d, t in rows}, {d: d for d, _ in rows}
    for a, b in itertools.combinations(root, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    assert out == root
    assert counts["likely"] < 5 * len(rows)


def scattered(members, edits, seed):
    """Texts of 120 words about one base, each with up to ``edits`` changed words that a few others share."""
    rng, base = random.Random(seed), [f"b{i}" for i in range(120)]
    rows = []
    for _ in range(members):
        words = list(base)
        for _ in range(rng.randint(1, edits)):
            k = rng.randrange(120)
            words[k] = f"new{rng.randrange(2)}x{k}"
        rows.append(" ".join(words))
    return list(enumerate(rows))


@pytest.mark.parametrize("how", [{}, {"rare": 1}])
def test_members_that_stay_apart_are_not_tested_in_every_list(spark, monkeypatch, how):
    rows, counts = scattered(150, 7, 3), Counter()
    wrote = minhash.materialise

    def counted(df, name):
        out = wrote(df, name)
        counts[name] += out.count()
        return out
    monkeypatch.setattr(minhash, "materialise", counted)
    out = {r.doc_id: r.component_id
           for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    sets, root = {d: set(minhash.shingles(t).tolist()) for d, t in rows}, {d: d for d, _ in rows}
    for a, b in itertools.combinations(root, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    assert out == root and len(set(root.values())) > 20
    if not how:
        assert counts["likely"] < 2 * len(rows)


# ---- 8 mixing, 10 repeated passages

def test_the_mixture_is_written_compressed(spark, small, monkeypatch):
    paths, wrote = {}, mixing.materialise

    def seen(df, name, *how):
        paths[name] = (out := wrote(df, name, *how)).inputFiles()
        return out
    monkeypatch.setattr(mixing, "materialise", seen)
    assert mixing.draw(small).count() == small.count()
    meta = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in paths["mixture"]]
    assert {m.row_group(0).column(0).compression for m in meta if m.num_row_groups} == {"ZSTD"}


def test_keys_of_many_documents_leave_in_one_frame():
    texts = [" ".join(f"w{d}x{i}" for i in range(80)) for d in range(50)]
    batch = pd.DataFrame({"doc_id": range(50), "text": texts, "at": [suffixes.minimisers(suffixes.word_hashes(t)[0])[0] for t in texts]})
    frames = list(suffixes._keys(50)(iter([batch])))
    assert len(frames) == 1
    assert Counter(frames[0]["doc_id"]) == Counter({d: 31 for d in range(50)})
