"""Each operator against brute force on a small table, on edge cases and on an empty table."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hortus.llm import chat, decontaminate, exact_dedup, line_dedup, minhash, mixing, suffixes, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple((r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect()]


# ---- 3 exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[n], key=lambda g: g[:3])[3]
        out.append((d, keep, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("k", [1, 3, 256])
def test_exact_dedup(edge, small, k):
    for df in (edge, small):
        assert Counter(map(tuple, exact_dedup.exact_duplicates(df, k=k).collect())) == brute_exact(rows_of(df))


def test_heavy_digests_hold_every_frequent_one(spark):
    rows = [("a",)] * 400 + [("b",)] * 150 + [(f"x{i}",) for i in range(450)]
    df = spark.createDataFrame(rows, "d string").repartition(7)
    assert {r.d for r in exact_dedup.heavy_digests(df, "d", 8).collect()} >= {"a", "b"}


# ---- 7 near duplicates


def brute_near(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if d is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return Counter((d, len(sets[d]), find(d) if d is not None else None, d is None or d == find(d)) for d, _ in rows)


def test_near_duplicates(edge, small):
    for df in (edge, small):
        got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept if r.doc_id is not None else True)
                      for r in minhash.near_duplicates(df).collect())
        assert got == brute_near(rows_of(df))


def test_near_duplicates_chain_and_hot_group(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[4 * i:4 * i + 60] if i < 30 else words[:60] + [f"z{i}"])) for i in range(90)]
    rows += [(90 + i, " ".join(f"shared{j}" for j in range(30)) + " " + " ".join(f"q{i}_{j}" for j in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, minhash.near_duplicates(df).collect()))
    assert got == brute_near(rows)


# ---- 2 line dedup


def test_line_dedup(spark, edge, small):
    for unit in ("line", "paragraph"):
        rows = sorted((d, t) for d, t in set(rows_of(small)) if t is not None)
        seen, want = set(), {}
        for d, t in rows:
            kept = []
            for start, length, words in line_dedup.units(t, unit):
                if len(words.split()) >= 5 and words in seen:
                    continue
                seen.add(words)
                kept.append(t[start:start + length])
            want[d] = "".join(kept)
        got = {r.doc_id: r.text for r in line_dedup.drop_repeated(small, unit).collect()}
        assert got == want
    out = line_dedup.drop_repeated(edge).collect()
    assert len(out) == edge.count()
    assert {r.doc_id: r.n_removed for r in out}[7] == 1 and {r.doc_id: r.n_removed for r in out}[6] == 0


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    line = "the very same line of words"
    rows = [(1, f"{line}\nalpha"), (2, f"{line}\nbeta"), (2, "completely other text that is long enough here"),
            (3, "seen in both texts of three\none"), (3, "seen in both texts of three\ntwo"), (4, None), (None, line)]
    rows += rows[1:3]
    out = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.text, r.n_removed) for r in out)
    clean = Counter({(1, f"{line}\nalpha", 0): 1, (2, "beta", 1): 2, (2, "completely other text that is long enough here", 0): 2,
                     (4, None, 0): 1, (None, line, 0): 1})
    assert {k: c for k, c in got.items() if k[0] != 3} == clean
    three = sorted(((t, n) for d, t, n in got if d == 3), key=lambda r: r[1])
    assert [n for _, n in three] == [0, 1] and three[0][0].startswith("seen in both") and three[1][0] in ("one", "two")
    assert {three[0][0][-3:], three[1][0]} == {"one", "two"}


def test_line_offsets_rebuild_the_text(small):
    texts = dict(rows_of(small))
    for r in line_dedup.drop_repeated(small).where("n_removed > 0").collect():
        for s in r.removed:
            first = texts[s.keep_doc_id][s.keep_start:]
            cut = texts[r.doc_id][s.start:s.start + s.length]
            assert " ".join(first.lower().split()).startswith(" ".join(cut.lower().split()))


# ---- 4 token counts


def test_token_counts(edge, small):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df in (edge, small):
        want = Counter((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in rows_of(df))
        assert Counter(map(tuple, token_counts.token_counts(df, path).collect())) == want


def test_whole_words_are_single_tokens():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    spec = open(public.path("word_bpe_49k.json"), encoding="utf-8").read()
    tok, words = Tokenizer.from_str(spec), sorted(token_counts.whole_words(spec))
    assert len(words) > 20000 and all(len(e.ids) == 1 for e in tok.encode_batch(words[::37], add_special_tokens=False))
    counter = token_counts.Counter(spec, frozenset(words))
    for odd in ("á Å ﬁ ΑΣ Σ", "it's we'LL 'S ''s 1234 ٣٤", "\x1c\x85 x​y", "<|startoftext|><|endoftext|>a<|ENDOFTEXT|>", "😀😀!!'s", "ǅ ẞ İI"):
        assert counter.count(odd) == len(tok.encode(odd, add_special_tokens=False).ids), odd


# ---- 1 WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b\r\nx", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (None, "u", "same"), (2, "again", "same"), (6, "u", "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    got = Counter(map(tuple, warc.read_records(warc.write_archives(df, archive_bytes=200)).collect()))
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        first = best[h or ""]
        want[(p, len(b), warc.base32_sha1(b), "response" if p == first else "revisit", None if p == first else first)] += 1
    assert got == want
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_warc_dictionary_leads_the_archive(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    data = bytes(warc.write_archives(pages).first().archive)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    texts = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    heads = list(warc.read_archive(data))
    assert all(body == texts[int(h["X-Page-Id"])] for h, body in heads if h["WARC-Type"] == "response")


# ---- 5 decontamination


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_length():
    import random
    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 40))], [rng.randrange(6) for _ in range(rng.randrange(60))]
        assert decontaminate.common_length(decontaminate.Item._masks(a), len(a), b) == lcs(a, b)


def test_contaminated_finds_planted_passages(spark, small, edge, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(small, bench).collect()}
    exact = {(d, i) for d, t in rows_of(small) for i, s in items.items() if t and s in t}
    assert exact <= got
    base = [t for _, t in rows_of(small) if t and len(t) > 500]
    paraphrase = items[3].split()
    paraphrase[2:4] = ["quite"]
    planted = spark.createDataFrame([(1, base[0] + " " + " ".join(paraphrase) + " " + base[1]), (2, base[2]), (3, None), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(planted, bench.where("item_id = 3")).collect()} == {(1, 3)}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(edge, bench.limit(0)).count() == 0
    assert decontaminate.keep_uncontaminated(edge, bench).columns == edge.columns


def test_contaminated_misses_no_window(spark):
    """Verbatim and 30 % changed items in foreign text at every offset, against brute-force LCS over all runs of the item's length."""
    import random

    from hortus.llm.common import ALNUM, word_hashes
    rng = random.Random(5)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    items[-1] = " ".join(f"long{i}" for i in range(150))  # more words than a machine word has bits
    hashes = {i: word_hashes(s, ALNUM)[0].tolist() for i, s in items.items()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    pool = [w for _, t in rows_of(docs.where("lang = 'en'")) for w in (t or "").split()]
    rows, want = [], set()
    for i, s in items.items():
        for changed in (False, True) * 3:
            words = s.split()
            for x in rng.sample(range(len(words)), int(0.3 * len(words)) if changed else 0):
                words[x] = f"other{x}"
            at, lead = -len(rows) - 1, rng.randrange(100, 200)
            rows.append((at, " ".join(rng.choices(pool, k=lead) + words + rng.choices(pool, k=rng.randrange(60, 160)))))
            doc, item = word_hashes(rows[-1][1], ALNUM)[0].tolist(), hashes[i]
            n = len(item)
            need, tail = max(-(-7 * n // 10), min(n, 5)), item[n - max(1, n // 4):]
            for p in range(lead - 8, lead + 9):
                window = doc[p:p + n]
                if (decontaminate.common_length(decontaminate.Item._masks(item), n, window) >= need
                        and decontaminate.common_length(decontaminate.Item._masks(tail), len(tail), window) >= 0.5 * len(tail)):
                    want.add((at, i))
                    break
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs.drop("lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    assert len(want) > 5 * len(items)
    assert want <= got


# ---- 6 toxicity


def test_toxicity_held_out(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("pmod(xxhash64(doc_id, 5), 4) > 0")
    rows = docs.select("doc_id").join(labels.withColumnRenamed("toxic", "truth"), "doc_id").join(train, "doc_id", "left_anti")
    both = rows.join(toxicity.score_documents(docs, train), "doc_id").collect()
    right = sum((x.truth == 1) == x.toxic for x in both) / len(both)
    assert right >= 0.95
    assert all(0 <= x.severity <= 2 and abs(x.severity - x.p_toxic) <= 1 for x in both)
    assert toxicity.score_documents(edge, labels).count() == edge.count()
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.keep_clean(edge, labels.limit(0)).count() == edge.count()


# ---- 8 mixing


def test_targets_and_quotas():
    assert mixing.targets([100, 1, 50], [1, 2, 3]) == pytest.approx([37.0, 3, 111.0])
    quotas = mixing.split_quotas([7, 0, 100], 16, 1)
    assert [sum(q[i] for q in quotas) for i in range(3)] == [7, 0, 100]
    assert max(map(sum, quotas)) - min(map(sum, quotas)) <= 1


def test_mix(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken, r.shards) for r in out) == sorted((r.doc_id, r.taken, r.shards) for r in again)
    size, taken, goal, most = Counter(), Counter(), {}, Counter()
    texts = dict(rows_of(docs))
    for r in out:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.taken <= 3 * r.size and r.taken == r.size * len(r.shards)
        size[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
    assert sum(goal.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - goal[s]) <= most[s] and goal[s] <= 3 * size[s] + 1e-6 for s in size)
    assert mixing.mix(edge).count() == edge.count() and mixing.mix(empty).count() == 0
    copies = mixing.shard_rows(docs, mixing.mix(docs))
    assert copies.count() == sum(len(r.shards) for r in out)


def test_drawn_copies_hold_the_texts(edge, small, empty):
    for df in (edge, small):
        mixed = mixing.mix(df)
        planned = Counter((r.doc_id, r.source, r.taken, tuple(r.shards)) for r in mixed.collect())
        copies = mixing.shard_rows(df, mixed).collect()
        assert len(copies) == sum(len(k[3]) * n for k, n in planned.items())
        rows = mixing.draw(df, texts=True).collect()
        assert Counter((r.doc_id, r.source, r.taken, tuple(r.shards)) for r in rows) == planned
        texts = {(r.doc_id, r.source, r.text) for r in df.collect()}
        assert all(r.text is None if not r.shards else (r.doc_id, r.source, r.text) in texts for r in rows)
        assert all(r.taken == len(r.shards) * len(WORD.findall(r.text or "")) for r in rows)
    assert mixing.draw(empty, texts=True).count() == 0


# ---- 9 chat


@pytest.mark.parametrize("budget,history", [(512, 2), (3, 1), (1, 3)])
def test_chat_round_trip(spark, budget, history):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "be kind"), ("user", said), ("assistant", said), ("user", "a\\<|b\\"), ("assistant", ""), ("assistant", "x\n<|im_end|>\n"), ("user", None), ("assistant", "\\|<\\|<<|im_sep|>")])]
    rows += [(2, None, None, None), (2, 0, "assistant", "é😀 <"), (2, 0, "assistant", "é😀 <"), (None, 1, "assistant", "n"), (3, 0, "us\ner<|im_sep|>", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(9))
    windows = chat.format_windows(df, budget, history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = [r for r in rows if r[0] == conv]
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        target = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    for r in windows.where("conv_id = 1 and window > 0").collect():
        assert r.formatted.startswith("<|im_start|>system<|im_sep|>be kind") and r.n_repeated >= 1
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


# ---- 10 sparse suffixes


def covered(rows, least=50):
    """Words inside runs of ``least`` words that occur more than once."""
    where = defaultdict(list)
    words = {d: WORD.findall((t or "").lower()) for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i:i + least])].append((d, i))
    out = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                out[d].update(range(i, i + least))
    return out


def test_repeated_passages(spark, edge, empty):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join(f"a{i}_{j}" for j in range(10 + 7 * i)) + " " + passage + " " + " ".join(f"b{i}_{j}" for j in range(30))) for i in range(9)]
    rows += [(20, " ".join(f"c{j}" for j in range(400))), (21, " ".join(f"c{j}" for j in range(100, 300))), (22, passage[:100]), (23, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: {x for s in r.spans for x in range(s.start, s.stop)} for r in suffixes.repeated_passages(df).collect()}
    assert got == dict(covered(rows))
    assert suffixes.repeated_passages(empty).count() == 0
    assert {6, 7, 8} <= {r.doc_id for r in suffixes.repeated_passages(edge).collect()}


def test_repeated_passages_on_the_documents(small):
    want = covered(rows_of(small))
    got = {r.doc_id: {x for s in r.spans for x in range(s.start, s.stop)} for r in suffixes.repeated_passages(small).collect()}
    assert set(got) == set(want)
    assert all(want[d] == got[d] for d in want)


def test_repeated_passages_behind_a_hot_tail(spark):
    """The true pairs share 52 words that end in a tail which many others have behind other words."""
    tail = " ".join(f"t{j}" for j in range(45))
    rows = [(i, f"{' '.join(f'x{i}_{j}' for j in range(40))} {tail} {' '.join(f'y{i}_{j}' for j in range(20))}") for i in range(300)]
    for i in range(40):
        lead = " ".join(f"lead{i}_{j}" for j in range(7))
        rows += [(1000 + 2 * i + k, f"{' '.join(f'u{i}_{k}_{j}' for j in range(30))} {lead} {tail} {' '.join(f'v{i}_{k}_{j}' for j in range(20))}") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: {x for s in r.spans for x in range(s.start, s.stop)} for r in suffixes.repeated_passages(df).collect()}
    assert got == dict(covered(rows)) and len(got) == 80


def test_repeated_passages_of_more_words(spark):
    shared = " ".join(f"s{j}" for j in range(150))
    rows = [(i, f"{' '.join(f'a{i}_{j}' for j in range(20))} {shared} {' '.join(f'b{i}_{j}' for j in range(20))}") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x for s in r.spans for x in range(s.start, s.stop)} for r in suffixes.repeated_passages(df, least=100).collect()}
    assert got == dict(covered(rows, 100)) and len(got) == 2


def test_toxicity_recall_and_false_alarms(spark):
    """The mark chosen on held-out folds catches toxic texts that no fit has seen and leaves clean ones alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("doc_id % 3 > 0")
    truth = labels.filter("doc_id % 3 = 0 and toxic is not null").select("doc_id", F.col("toxic").alias("truth"))
    rows = truth.join(toxicity.score_documents(docs, train), "doc_id").collect()
    assert sum(r.toxic for r in rows if r.truth) >= 0.9 * sum(r.truth for r in rows)
    assert sum(r.toxic for r in rows if not r.truth) <= 0.06 * sum(not r.truth for r in rows)


def test_held_out_mark_of_few_rows():
    import numpy as np
    assert toxicity.held_out_mark(np.zeros((6, 2), np.float32), np.array([0, 0, 1, 1, 0, 0]), 3) == 0.5
