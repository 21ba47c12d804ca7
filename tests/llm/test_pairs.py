"""Joins and links against brute force, components, and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import graph, jaccard_join, nn_descent
from loomtext.llm.graph import components, spread
from loomtext.llm.store import Store, shared_dir


def merged(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_join(data, k, percent):
    sets = {}
    for doc, text, *_ in data:
        if doc is not None:
            sets[doc] = shingle_set(text, k)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = merged(sets, links)
    return sorted(((d, len(shingle_set(t, k)), None if d is None else found[d]) for d, t, *_ in data), key=str)


def corpus(seed, n=260):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocab, 60))
    base = [list(rng.choice(vocab, int(rng.integers(5, 90)))) for _ in range(12)]
    out = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "One two"), (1006, "one  two"), (None, "one two"), (1007, "a b c d"), (1008, "é b c"), (1009, "É b c"), (1010, "a b\x1cc")]
    for i in range(n):
        words = list(base[int(rng.integers(12))])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = str(rng.choice(vocab))
        if rng.random() < 0.3:
            words = passage + list(rng.choice(vocab, int(rng.integers(1, 40))))
        out.append((i, " ".join(words)))
    return [(*r, "extra") for r in out]


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_jaccard_join(spark, k, percent, seed):
    data = corpus(seed)
    df = spark.createDataFrame(data, "doc_id long, text string, rep string").repartition(5)
    assert sorted(map(tuple, jaccard_join.join(df, k=k, percent=percent).collect()), key=str) == brute_join(data, k, percent)


def test_jaccard_join_of_large_regions(spark, monkeypatch):
    """Small limits, so that tiles and regions within regions are used."""
    for name, value in (("SMALL", 3), ("TILE", 8), ("LIMIT", 30), ("TILE_SHINGLES", 600)):
        monkeypatch.setattr(jaccard_join, name, value)
    data = corpus(4, 150)
    df = spark.createDataFrame(data, "doc_id long, text string, rep string")
    assert sorted(map(tuple, jaccard_join.join(df).collect()), key=str) == brute_join(data, 4, 85)


def passages(copies, others):
    """Near copies of one text, and texts that share most of it but don't link."""
    base = [f"p{i}" for i in range(200)]
    texts = [" ".join([*base[:-1], f"copy{i}"]) for i in range(copies)]
    texts += [" ".join([*base[:140], *[f"own{i}x{j}" for j in range(60)]]) for i in range(others)]
    return [(i, t) for i, t in enumerate(texts)]


def counted(monkeypatch, name):
    """The rows that go into and come from a step of the join."""
    rows, step = [], getattr(jaccard_join, name)

    def run(members, *more):
        out = step(members, *more)
        rows.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, name, run)
    return rows


def test_tiles_of_one_label_do_not_meet(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("TILE", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows, made = counted(monkeypatch, "_tiled"), []
    for copies in (64, 128):
        data, at = passages(copies, 6), len(rows)
        got = jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got), key=str) == brute_join(data, 4, 85)
        made.append(rows[at])  # those of the windows
    assert all(out <= 3 * into for into, out in made) and made[1][1] <= 2.5 * made[0][1]


def test_merged_regions_lose_no_pair_and_add_no_work(spark):
    rng = np.random.default_rng(5)
    rows = [(r, int(x), int(x) // 3) for r in range(40) for x in rng.choice(50, 40, replace=False)]
    rows += [(100 + r, int(x), int(x)) for r in range(60) for x in [0, *rng.choice(np.arange(1000, 1200), 3, replace=False)]]

    def meet(rows):
        held = {}
        for region, rep, label, *_ in rows:
            held.setdefault(region, {})[rep] = label
        pairs = {(a, b) for h in held.values() for a in h for b in h if a < b and h[a] != h[b]}
        return pairs, sum(map(len, held.values())), sum(len(h) ** 2 for h in held.values())

    store = Store(spark, "test")
    opened = store.cut(jaccard_join._open(spark.createDataFrame(rows, "region long, rep long, label long")), "open")
    before = [tuple(r) for r in opened.collect()]
    after = [tuple(r) for r in jaccard_join._merged(opened, store).collect()]
    (pairs, n, work), (now, m, less) = meet(before), meet(after)
    assert pairs <= now and less <= work and m < n - 1000
    sizes = {}
    for region, *_ in after:
        sizes[region] = sizes.get(region, 0) + 1
    assert all(size == sizes[region] for region, _, _, size in after)


def tasks(spark, f):
    """How many tasks ``f`` runs, and its result."""
    sc, group = spark.sparkContext, f"tasks {f} {id(f)}"
    sc.setJobGroup(group, group)
    try:
        out = f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return sum(i.numCompletedTasks for i in infos if i), out


@pytest.fixture
def forty(spark):
    """Shuffles of 40 partitions, however few the rows."""
    now = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_rows_are_not_shuffled(spark, forty):
    """Components and merged regions of small tables don't pay for each partition of a shuffle, round by round."""
    store = Store(spark, "test")
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long").coalesce(1)
    n, found = tasks(spark, lambda: components(links, store).collect())
    assert {tuple(r) for r in found} == {(i, 0) for i in range(61)} and n < 40
    rows = [(r, x, x) for r in range(40) for x in range(3 + r % 2)]
    opened = store.cut(jaccard_join._open(spark.createDataFrame(rows, "region long, rep long, label long").coalesce(1)).coalesce(1), "open")
    n, found = tasks(spark, lambda: jaccard_join._merged(opened, store).collect())
    assert {(r.rep, r.label) for r in found} == {(x, x) for x in range(4)} and n < 40


def test_few_rows_or_many_give_the_same(spark, monkeypatch):
    """Tables that are too large for one task: components in rounds, regions merged in shuffles."""
    monkeypatch.setattr(graph, "FEW", 0)
    test_merged_regions_lose_no_pair_and_add_no_work(spark)
    for links in ([], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(50, 51), (51, 50), (7, 7)], [(i * 37 % 101, i * 53 % 101) for i in range(90)]):
        test_components(spark, links)
    test_components_with_a_hub(spark, monkeypatch)
    data = corpus(6, 150)
    df = spark.createDataFrame(data, "doc_id long, text string, rep string")
    assert sorted(map(tuple, jaccard_join.join(df).collect()), key=str) == brute_join(data, 4, 85)


def test_jaccard_counts_are_exact():
    """At sizes where single precision would round: 100 * 671109 is 85 * 789540, and one less isn't linked."""
    universe = np.arange(789_540, dtype=np.uint64) * np.uint64(11400714819323198485)
    universe.sort()
    inside = np.zeros(len(universe), bool)
    inside[np.random.default_rng(0).permutation(len(universe))[:671_109]] = True
    less = inside.copy()
    less[np.flatnonzero(inside)[0]] = False
    assert jaccard_join._linked([universe, universe[inside]], 85)[0, 1] and not jaccard_join._linked([universe, universe[less]], 85)[0, 1]
    sketch = jaccard_join.sketches([universe, universe[inside]])
    assert jaccard_join._in_window(sketch[:1], sketch[1:], np.array([789_540 + 671_109]), 85).all()


def test_jaccard_join_at_the_threshold(spark):
    words = [f"w{i}" for i in range(1000)]
    data = [(1, " ".join(words)), (2, " ".join(words[:850])), (3, " ".join(words[:849])), (4, " ".join(words[150:]))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(df, k=1).collect())) == [(1, 1000, 1), (2, 850, 1), (3, 849, 1), (4, 850, 1)]
    assert sorted(map(tuple, jaccard_join.join(df.where("doc_id in (1, 3)"), k=1).collect())) == [(1, 1000, 1), (3, 849, 3)]


def test_jaccard_join_of_repeated_ids(spark):
    """Rows of one id are documents of their own."""
    base = corpus(8, 60)
    data = [(d if d is None else d % 17, t, e) for d, t, e in base] + [(5, base[-1][1], "a"), (5, base[-1][1], "a"), (5, base[-2][1], "a"), (5, None, "a")]
    got = jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string, rep string"), links=True)
    sets = [set() if d is None else shingle_set(t, 4) for d, t, _ in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    found = merged(range(len(data)), links)
    least = {}
    for i, c in found.items():
        if data[i][0] is not None:
            least[c] = min(least.get(c, 1 << 60), data[i][0])
    count = [0] * len(data)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    want = [(d, len(shingle_set(t, 4)), None if d is None else least[found[i]], count[i]) for i, (d, t, _) in enumerate(data)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_links(spark, monkeypatch, small):
    for name, value in (("SMALL", 3), ("TILE", 8), ("LIMIT", 30), ("TILE_SHINGLES", 600)) if small else ():
        monkeypatch.setattr(jaccard_join, name, value)
    data = corpus(5, 150)
    data += [(0, data[-1][1], "again"), (0, data[-2][1], "again"), (7, data[19][1], "same"), (None, data[19][1], "null"), (2000, data[19][1], "copy")]
    df = spark.createDataFrame(data, "doc_id long, text string, rep string")
    got = jaccard_join.join(df, links=True)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    sets = [(d, shingle_set(t, 4)) for d, t, _ in data]
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 85 * len(a | b)
    want = [(d, len(a), 0 if d is None else sum(j != i and e is not None and near(a, b) for j, (e, b) in enumerate(sets))) for i, (d, a) in enumerate(sets)]
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got.collect()), key=str) == sorted(want, key=str)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_slices_never_miss(percent):
    """Pairs at the threshold share a mark, whatever differs."""
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = set(rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist())
        b = set(a)
        while True:
            c = set(b)
            if rng.random() < 0.5 and len(c) > 1:
                c.discard(next(iter(c)))
            else:
                c.add(int(rng.integers(0, 1 << 63)))
            if 100 * len(a & c) < percent * len(a | c):
                break
            b = c
        sets = [np.array(sorted(s), np.uint64) for s in (a, b)]
        who, mark = jaccard_join.slice_marks(sets, percent)
        assert set(mark[who == 0].tolist()) & set(mark[who == 1].tolist())


def brute_vectors(data, threshold=0.93):
    fine = [(i, r) for i, r in enumerate(data) if r[0] is not None and r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    links, count = [], {}
    for i, r in fine:
        for j, q in fine:
            if i != j and r[1] == q[1] and len(r[2]) == len(q[2]):
                x, y = np.array(r[2], np.float64), np.array(q[2], np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((r[0], q[0]))
                    count[i] = count.get(i, 0) + 1
    found = merged({r[0] for r in data if r[0] is not None}, links)
    return sorted(((r[0], count.get(i, 0), found.get(r[0]), r[0] is None or found[r[0]] == r[0]) for i, r in enumerate(data)), key=str)


def vectors(seed):
    rng = np.random.default_rng(seed)
    f = lambda x: [float(v) for v in np.asarray(x, np.float32)]
    out = []
    for i in range(120):
        out.append((i, int(i % 3), f(rng.standard_normal(16))))
    for c in range(3):  # families larger than a list
        centre = rng.standard_normal(16)
        for i in range(40):
            out.append((200 + 50 * c + i, int(c % 2), f(centre + 0.08 * rng.standard_normal(16))))
    out += [(500 + i, 0, out[3][2]) for i in range(5)] + [(3, 0, out[3][2])]  # copies, one a repeated row
    out += [(600, None, out[0][2]), (601, 0, None), (602, 0, [0.0] * 16), (603, 0, [float("nan")] + [1.0] * 15), (604, 0, [None] + [1.0] * 15), (605, 0, [float("inf")] + [1.0] * 15), (606, 0, []), (607, 0, [1.0, 2.0]), (608, 0, [2.0, 4.0]), (None, 0, out[0][2])]
    return out


def test_links(spark):
    data = vectors(5)
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, label int, embedding array<float>, node int").repartition(3)
    assert sorted(map(tuple, nn_descent.link(df).collect()), key=str) == brute_vectors(data)


def test_links_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "TILE", 16)
    data = vectors(6)
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, nn_descent.link(df).collect()), key=str) == brute_vectors(data)


def test_links_of_saturated_families(spark, caplog):
    """Families at 0.995 inside and 0.94 across: every list is full of links of its own family."""
    rng = np.random.default_rng(8)
    data = []
    for label, (m, dim) in enumerate([(20, 48), (200, 48)]):
        base = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        a = base[0]
        b = 0.945 * base[0] + np.sqrt(1 - 0.945**2) * base[1]
        for f, centre in enumerate((a, b)):
            for i in range(m):
                noise = rng.standard_normal(dim - 2) @ base[2:]
                x = centre + 0.07 * noise / np.linalg.norm(noise)
                data.append((1000 * label + 500 * f + i, label, [float(v) for v in x]))
        far = -0.1 * base[0] + base[2]  # a third family, linked with none
        for i in range(m):
            data.append((10000 + 1000 * label + i, label, [float(v) for v in far + 0.01 * rng.standard_normal(dim)]))
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").repartition(3)
    with caplog.at_level("INFO", logger="loomtext.llm.nn_descent"):
        got = sorted(map(tuple, nn_descent.link(df).collect()), key=str)
    want = brute_vectors(data)
    assert {r[2] for r in want} == {0, 1000, 10000, 11000} and {r[1] for r in want if r[0] < 500} == {39}
    assert got == want
    assert [r.args[1] for r in caplog.records] == [nn_descent.TABLES]  # no audit failed


@pytest.mark.parametrize(("pairs", "every"), [(12, True), (40, False)])
def test_links_when_the_audit_fails(spark, monkeypatch, caplog, pairs, every):
    """Short windows without a descent miss links: projections go on, or all pairs are compared."""
    for name, value in (("TABLES", 1), ("WINDOW", 4), ("STRIDE", 2), ("ROUNDS", 0), ("TILE", 32)):
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(12)
    data = []
    for i in range(pairs):
        x, noise = rng.standard_normal((2, 32))
        for j in (0, 1):
            data.append((2 * i + j, 0, [float(v) for v in x + j * 0.3 * noise]))
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    with caplog.at_level("INFO", logger="loomtext.llm.nn_descent"):
        got = sorted(map(tuple, nn_descent.link(df).collect()), key=str)
    want = brute_vectors(data)
    audits = [r.args[2] for r in caplog.records if r.levelname == "INFO"]
    assert audits[0] < nn_descent.RECALL and any(r.levelname == "WARNING" for r in caplog.records) == every
    assert got == want


def test_forest():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (30, 30), (40, 20)):
        near = rng.random((n, m)) < 0.04
        rows, cols = np.arange(n), np.arange(100, 100 + m)
        nodes = [*rows.tolist(), *cols.tolist()]
        u, v = nn_descent._forest(near, rows, cols)
        assert merged(nodes, zip(u.tolist(), v.tolist(), strict=True)) == merged(nodes, [(int(rows[a]), int(cols[b])) for a, b in zip(*np.nonzero(near), strict=True)])


def test_links_of_nothing(spark):
    assert nn_descent.link(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(50, 51), (51, 50), (7, 7)], [(i * 37 % 101, i * 53 % 101) for i in range(90)]])
def test_components(spark, links):
    store = Store(spark, "test")
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long"), store).collect()))
    links = [e for e in links if e[0] != e[1]]
    want = merged({n for e in links for n in e}, links)
    assert got == want


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_pipeline(spark, tmp_path):
    """Stages against plain versions: who stays, what is hidden, what is packed."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from loomtext.llm import bpe, packing

    rng = np.random.default_rng(9)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(300):
        words = list(rng.choice(vocab, 40))
        toxic = i % 5 == 0
        if toxic:
            words[3] = words[20] = "vile"
        text = " ".join(words) + (" card 4041894974608795" if i % 7 == 0 else "")
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "s", len(docs[i][1])) for i in range(30)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        kept.append({r.doc_id: r.text for r in now.collect()})
    clean = {d[0]: d[1] for d in docs if "vile" not in (d[1] or "")}
    assert kept[0] == clean
    assert set(kept[1]) == {d for d in clean if d < 1000 or d >= 2000}
    assert all("4041894974608795" not in (t or "") for t in kept[2].values()) and sum(t != kept[1][d] for d, t in kept[2].items()) == sum("card" in (t or "") for t in kept[1].values())
    got: dict = {}
    for r in sorted(pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    ids = packing.fast_ids(bpe.default_vocabulary())
    assert got == {d: [*ids(t or "").tolist(), 1] for d, t in kept[2].items()}


def test_near_copies_of_repeated_and_null_ids(spark):
    """One row of each class stays, whatever the ids."""
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    docs = [(1, a), (1, a), (2, a), (3, b), (3, a), (None, c), (None, c), (None, a), (5, d), (4, d + " end"), (None, None), (6, ""), (6, "")]
    df = spark.createDataFrame([(*r, "en") for r in docs], "doc_id long, text string, lang string").repartition(3)
    got = pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (3, b), (None, c), (4, d + " end"), (None, None), (6, ""), (6, "")], key=str)


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_windows_never_miss_and_part_the_unrelated(percent):
    rng = np.random.default_rng(percent)
    new = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    pairs = []
    for n in (1, 5, 60, 300, 1100, 5000):
        for _ in range(20):
            base = new(n)
            extra = int(len(base) * (100 - percent) / 100)
            pairs.append((base, base[: len(base) - extra] if rng.random() < 0.5 else np.union1d(base, new(int(extra * 100 / 101)))))
    linked = [100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for a, b in pairs]
    x, y = jaccard_join.sketches([a for a, _ in pairs]), jaccard_join.sketches([b for _, b in pairs])
    ok = jaccard_join._in_window(x, y, np.array([len(a) + len(b) for a, b in pairs]), percent)
    assert sum(linked) > 60 and all(o for o, k in zip(ok, linked, strict=True) if k)
    far = [(new(n), new(n)) for n in (300, 1100, 5000, 20000)]
    ok = jaccard_join._in_window(jaccard_join.sketches([a for a, _ in far]), jaccard_join.sketches([b for _, b in far]), np.array([len(a) + len(b) for a, b in far]), percent)
    assert percent < 80 or not ok.any()


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_joins_with_hot_keys(spark, hot):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 3, i) for i in range(200)], "k long, x long")
    keys = rows.groupBy("k").count().withColumnRenamed("count", "size").withColumn("y", -F.col("k"))
    got = spread(rows, keys, ["k"], "size", 200, hot)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keys, "k").collect())) and got.columns == ["k", "x", "size", "y"]


def test_components_with_a_hub(spark, monkeypatch):
    from loomtext.llm import graph

    monkeypatch.setattr(graph.spread, "__defaults__", (4, 8))
    links = [(i, 1000) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 2000)]
    got = components(spark.createDataFrame(links, "u long, v long"), Store(spark, "test"))
    assert {r.node: r.component for r in got.collect()} == merged({x for p in links for x in p}, links)


def test_the_audit_sees_what_large_families_hide(spark):
    """A thousand found links of one family don't make up for lost pairs."""
    from loomtext.llm.nn_descent import _audit, _packed

    rng = np.random.default_rng(0)
    hub, vectors = rng.standard_normal(16), []
    for i in range(60):
        vectors.append(hub + rng.standard_normal(16) * 0.01)
    for i in range(30):
        a = rng.standard_normal(16)
        vectors += [a, a + rng.standard_normal(16) * 0.01]
    nodes = spark.createDataFrame([(i, 1, 16, v.tolist(), 1) for i, v in enumerate(vectors)], "node long, label int, dim int, vector array<float>, copies long")
    nodes = _packed(nodes)
    every = [(i, 59) for i in range(60)] + [(i, 1) for i in range(60, 120)]
    lost = [(i, d) for i, d in every if i < 90]
    frame = lambda x: spark.createDataFrame(x, "node long, degree long")
    assert _audit(nodes, frame(every), 0.93) == 1 and 0.7 < _audit(nodes, frame(lost), 0.93) < 0.8
    assert _audit(nodes.where("false"), frame(every), 0.93) == 1


def test_links_report(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist(), i % 2) for i in range(50)], "vec_id long, embedding array<float>, label int")
    told: dict = {}
    nn_descent.link(df, report=told)
    assert told["nodes"] == 50 and told["recall"] >= nn_descent.RECALL and told["projections"] % nn_descent.TABLES == 0 and told["exact"] in (True, False)


def test_tables_are_dropped(spark):
    import os

    store = Store(spark, "test")
    a, b = (store.cut(spark.range(3), x) for x in "ab")
    store.only(b)
    assert not os.path.exists(a._loomtext_path) and b.count() == 3 and store.made == [b]


def test_pipeline_stages_with_clashing_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"word{i} clean text of {i}", f"g{i}", 0.5, i, "r") for i in range(40)] + [(100 + i, f"vile word{i} text {i}", "bad", 0.1, i, "r") for i in range(20)] + [(None, None, None, None, None, None), (1, "x@b.cd " + "a. " * 50_000, "g", 1.0, 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string, p_toxic double, grade int, __row string")
    spark.createDataFrame([(i, int(i >= 100)) for i, *_ in rows[:-2]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for _, stage in pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    got = {(r.doc_id, r.severity, r.grade) for r in now.collect()}
    assert got == {(r[0], r[2], r[4]) for r in rows if r[2] != "bad"}
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
