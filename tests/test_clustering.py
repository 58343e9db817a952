import itertools
import random

import numpy as np
import pytest

from kinprint.operators import clustering as cl
from kinprint.operators import components, edit, pairs, projection, video

N_BITS = 12


def sample(spark, n=40, seed=0, copies=True):
    rnd = random.Random(seed)
    values = [rnd.getrandbits(N_BITS) for _ in range(n)]
    if copies:
        values[5] = values[1]
        values[7] = values[1]
    words = [v << (32 - N_BITS) for v in values]
    return values, spark.createDataFrame([(k, [w]) for k, w in enumerate(words)], "file_idx long, words array<long>")


def dist(a, b):
    return (a ^ b).bit_count()


def slow_components(values, t):
    leader = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(values)), 2):
            if dist(values[i], values[j]) <= t and leader[i] != leader[j]:
                leader[i] = leader[j] = min(leader[i], leader[j])
                changed = True
    return leader


def slow_linkage(values, linkage, cut):
    groups = {i: [i] for i in range(len(values))}
    merges = []
    while len(groups) > 1:
        best = None
        for a, b in itertools.combinations(sorted(groups), 2):
            ds = [dist(values[x], values[y]) for x in groups[a] for y in groups[b]]
            d = {"single": min(ds), "complete": max(ds), "average": sum(ds) // len(ds)}[linkage]
            if best is None or (d, a, b) < best:
                best = (d, a, b)
        d, a, b = best
        if d > cut:
            break
        merges.append((a, b, d))
        groups[a] += groups.pop(b)
    return {x: min(g) for g in groups.values() for x in g}, merges


def test_pairs_and_stats(spark):
    values, h = sample(spark)
    want = {(i, j): dist(values[i], values[j]) for i, j in itertools.combinations(range(len(values)), 2)}
    every = pairs.all_pairs(h, N_BITS)
    assert {(r["i"], r["j"]): r["d"] for r in every.collect()} == want
    for t in (0, 1, 3, 12):
        got = [tuple(r) for r in pairs.similar_pairs(h, N_BITS, t).collect()]
        assert sorted(got) == sorted((i, j, d) for (i, j), d in want.items() if d <= t)
    s = pairs.stats(every).first()
    assert (s[0], s[1]) == (min(want.values()), max(want.values())) and s[2] == pytest.approx(np.mean(list(want.values())))
    assert tuple(pairs.stats(every.filter("false")).first()) == (0, 0, 0.0)
    row = next(r for r in pairs.matrix_rows(h, every).collect() if r["i"] == 3)
    assert row["distances"] == [dist(values[3], v) for v in values]


def joined_or_shuffled(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("CartesianProduct", "SortMergeJoin", "Window", "SortAggregate", "ObjectHashAggregate") if x in plan]


def test_pairs_are_not_shuffled(spark):
    _, h = sample(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not joined_or_shuffled(pairs.all_pairs(h, N_BITS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matrix_text(spark):
    values, h = sample(spark)
    rows = pairs.matrix_text(h)
    assert not joined_or_shuffled(rows)
    assert {r["i"]: r["distances"] for r in rows.collect()} == {i: ",".join(str(dist(v, x)) for x in values) for i, v in enumerate(values)}
    assert pairs.matrix_text(h.filter("false")).count() == 0
    wide = spark.createDataFrame([(9, [0xFFFFFFFF, 1, 0]), (4, [0, 0, 1 << 31])], "file_idx long, words array<long>")
    assert {r["i"]: r["distances"] for r in pairs.matrix_text(wide, ";").collect()} == {4: "0;34", 9: "34;0"}


def slow_cores(values, m):
    k = max(1, min(m, len(values)) - 1)
    return [sorted(dist(v, x) for j, x in enumerate(values) if j != i)[k - 1] for i, v in enumerate(values)]


@pytest.mark.parametrize("m", [2, 3, 9, 99])
def test_core_distances_without_pairs(spark, m):
    values, h = sample(spark)
    found = pairs.core_distances(h, m)
    assert not joined_or_shuffled(found)
    assert {r["file_idx"]: r["core"] for r in found.collect()} == dict(enumerate(slow_cores(values, m)))
    assert pairs.core_distances(h.limit(1), m).count() == 0 and pairs.core_distances(h.filter("false"), m).count() == 0


def test_mutual_reachability_shuffles_no_pairs(spark):
    values, h = sample(spark)
    core = slow_cores(values, 3)
    found = pairs.mutual_reachability(h, N_BITS, 3)
    want = {(i, j): max(dist(values[i], values[j]), core[i], core[j]) for i, j in itertools.combinations(range(len(values)), 2)}
    assert {(r["i"], r["j"]): r["w"] for r in found.collect()} == want
    plan = pairs.mutual_reachability(h, N_BITS, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") == 1 and "Window" not in plan and "CartesianProduct" not in plan


def many(spark, n=1500):
    """Hashes with copies and gaps between their indices, out of order: (idx, values, frame)."""
    rng = np.random.default_rng(5)
    idx, values = rng.permutation(3 * n)[:n], rng.integers(0, 1 << N_BITS, n // 3)[rng.integers(0, n // 3, n)]
    rows = [(int(k), [int(v) << (32 - N_BITS)]) for k, v in zip(idx, values, strict=True)]
    return idx, values, spark.createDataFrame(rows, "file_idx long, words array<long>")


def written_pairs(spark, frame, path):
    """The rows (i, j, value) in order, and the bytes a row that they take."""
    frame.write.parquet(str(path))
    back = spark.read.parquet(str(path)).toArrow()
    rows = np.stack([c.to_numpy() for c in back.columns], axis=1)
    return rows[np.lexsort(rows.T[1::-1])], sum(p.stat().st_size for p in path.glob("*.parquet")) / len(rows)


def wanted_pairs(idx, values, floor):
    order = np.argsort(idx)
    idx, values, floor = idx[order], values[order], floor[order]
    i, j = np.triu_indices(len(idx), 1)
    w = np.maximum(np.bitwise_count(values[i] ^ values[j]), np.maximum(floor[i], floor[j]))
    rows = np.stack([idx[i], idx[j], w], axis=1)
    return rows[np.lexsort(rows.T[1::-1])]


def test_mutual_reachability_takes_little_room(spark, tmp_path):
    idx, values, h = many(spark)
    d = np.sort(np.bitwise_count(values[:, None] ^ values[None]), axis=1)  # first a hash itself
    rows, size = written_pairs(spark, pairs.mutual_reachability(h, N_BITS, 3), tmp_path / "w")
    assert np.array_equal(rows, wanted_pairs(idx, values, d[:, 2]))
    assert size < 0.8


def test_all_pairs_take_little_room(spark, tmp_path):
    idx, values, h = many(spark)
    rows, size = written_pairs(spark, pairs.all_pairs(h, N_BITS), tmp_path / "d")
    assert np.array_equal(rows, wanted_pairs(idx, values, np.zeros(len(idx), int)))
    assert size < 0.8


def test_all_pairs_of_odd_frames(spark):
    kind = "file_idx int, words array<long>"
    rows = [(4, [1, 0, 7]), (4, [1, 0, 6]), (None, [0, 0, 0]), (-2, [0xFFFFFFFF, 1, 0]), (9, [1, 0, 7])]
    frame = spark.createDataFrame(rows, kind)
    found = pairs.all_pairs(frame, 96)
    assert found.dtypes == pairs.joined_pairs(frame, 96).dtypes == [("i", "int"), ("j", "int"), ("d", "int")]
    want = [(-2, 4, 34), (-2, 4, 35), (-2, 9, 35), (4, 9, 0), (4, 9, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.joined_pairs(frame, 96).collect())) == want
    assert pairs.all_pairs(frame.limit(1), 96).count() == pairs.all_pairs(frame.filter("false"), 96).count() == 0


def test_find(spark):
    values, h = sample(spark)
    q = h.filter("file_idx in (1, 4)").selectExpr("file_idx as query", "words")
    got = [tuple(r) for r in pairs.find(h, q, N_BITS, top=5).collect()]
    want = [(k, i, d) for k in (1, 4) for d, i in sorted((dist(values[k], v), i) for i, v in enumerate(values))[:5]]
    assert sorted(got) == sorted(want)
    assert pairs.find(h, q, N_BITS, top=0).count() == 2 * len(values)
    assert all(r["d"] <= 2 for r in pairs.find(h, q, N_BITS, top=0, threshold=2).collect())


def test_find_makes_no_table_of_pairs(spark):
    values, h = sample(spark, 300)
    q = h.filter("file_idx % 7 = 0").selectExpr("file_idx as query", "words")
    want = sorted((k, i, d) for k in range(0, 300, 7) for d, i in sorted((dist(values[k], v), i) for i, v in enumerate(values))[:9])
    for frame in (h.repartition(5), h.coalesce(1)):
        found = pairs.find(frame, q, N_BITS, top=9)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == want
    near = pairs.find(h, q, N_BITS, top=9, threshold=1).collect()
    assert sorted(tuple(r) for r in near) == [x for x in want if x[2] <= 1]
    assert pairs.find(h, q.filter("false"), N_BITS, top=9).count() == 0


@pytest.mark.parametrize("t", [0, 2])
def test_threshold_groups_and_stats(spark, t):
    values, h = sample(spark)
    want = slow_components(values, t)
    members = cl.threshold_members(h, N_BITS, t).cache()
    assert [r["leader"] for r in members.orderBy("file_idx").collect()] == want
    ids = {x: k for k, x in enumerate(sorted(set(want)))}
    assert {r["file_idx"]: r["group"] for r in cl.with_group_ids(members).collect()} == {i: ids[x] for i, x in enumerate(want)}
    for r in cl.group_stats(h, members, N_BITS).collect():
        own = [i for i, x in enumerate(want) if x == r["leader"]]
        ds = [dist(values[a], values[b]) for a, b in itertools.combinations(own, 2)]
        assert (r["size"], r["max_internal_distance"]) == (len(own), max(ds)) and r["avg_internal_distance"] == pytest.approx(np.mean(ds))
    assert {r[0] for r in cl.ungrouped(members).collect()} == {i for i, x in enumerate(want) if want.count(x) == 1}


@pytest.mark.parametrize("linkage", cl.LINKAGES)
def test_linkage(spark, linkage):
    values, h = sample(spark, 30)
    want, merges = slow_linkage(values, linkage, 3)
    assert {r["file_idx"]: r["leader"] for r in cl.hierarchical(h, N_BITS, linkage, 3).collect()} == want
    got = cl.dendrogram(h, N_BITS, linkage, 3).orderBy("step").collect()
    assert [(r["merged_a"], r["merged_b"], r["distance"]) for r in got] == merges


@pytest.mark.parametrize("linkage", cl.LINKAGES)
def test_linkage_of_sparse_links_matches_the_definition(linkage):
    for seed in range(25):
        rnd = random.Random(seed)
        values = [rnd.getrandbits(7) for _ in range(26)]
        want, merges = slow_linkage(values, linkage, 3)
        first = [values.index(v) for v in dict.fromkeys(values)]
        different = [values[i] for i in first]
        ends = [(a, b, dist(different[a], different[b])) for a, b in itertools.combinations(range(len(first)), 2)]
        links = tuple(np.array(x) for x in zip(*[e for e in ends if e[2] <= 3], strict=True))
        words = np.array(different, np.uint64)[:, None]
        found = cl.Linkage(words, np.array([values.count(v) for v in different]), links, linkage, 3)
        assert [(first[a], first[b], d) for a, b, d in found.merges] == [m for m in merges if m[2]]
        assert {i: first[found.slot[different.index(v)]] for i, v in enumerate(values)} == want


@pytest.fixture(scope="module")
def connected(spark):
    """6,000 hashes of 13 bits with copies; they form one component at distance 2."""
    return spark.range(6000).selectExpr("id as file_idx", "array(shiftleft(pmod(id * 2731 + id % 7, 8192), 19)) as words")


@pytest.mark.parametrize("linkage", cl.LINKAGES)
def test_linkage_of_a_large_component(connected, linkage):
    rows = cl.hierarchical(connected, 13, linkage, 2).collect()
    assert len(rows) == 6000 and all(r["leader"] <= r["file_idx"] for r in rows)


def test_dendrogram_of_a_large_component(connected):
    merged = cl.dendrogram(connected, 13, "complete", 2).collect()
    leaders = {r["leader"] for r in cl.hierarchical(connected, 13, "complete", 2).collect()}
    assert len(merged) == 6000 - len(leaders) and sorted(r["step"] for r in merged) == list(range(len(merged)))


def test_greedy_of_a_large_component(connected):
    values = [r["words"][0] for r in connected.orderBy("file_idx").collect()]
    owner = {}
    for i, v in enumerate(values):
        owner[i] = min((j for j in set(owner.values()) if dist(values[j], v) <= 2), default=i)
    assert {r["file_idx"]: r["leader"] for r in cl.greedy(connected, 13, 2).collect()} == owner


def test_linkage_errors(spark):
    _, h = sample(spark, 5, copies=False)
    with pytest.raises(ValueError):
        cl.hierarchical(h, N_BITS, "ward", 3)
    with pytest.raises(ValueError):
        cl.cluster(h, N_BITS, "other")


def test_greedy_takes_direct_neighbours_only(spark):
    values, h = sample(spark)
    owner = {}
    for i in range(len(values)):
        if i not in owner:
            for j in range(i, len(values)):
                if j not in owner and dist(values[i], values[j]) <= 2:
                    owner[j] = i
    assert {r["file_idx"]: r["leader"] for r in cl.greedy(h, N_BITS, 2).collect()} == owner


def test_spanning_tree_weight():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 10, (25, 1)).astype(np.uint64)
    core = rng.integers(0, 4, 25)
    edges = cl.spanning_tree(words, core)
    d = cl.distances(words)
    w = {(i, j): max(core[i], core[j], d[i, j]) for i, j in itertools.combinations(range(25), 2)}
    total = 0
    for t in range(0, 12):
        root = list(range(25))
        for (i, j), x in w.items():
            if x <= t and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
        total += len(set(root)) - 1
    assert len(edges) == 24 and sum(e[0] for e in edges) == total


@pytest.mark.parametrize("m", [2, 3, 5])
def test_edges_by_blocks_are_those_of_one_machine(spark, m):
    rnd = random.Random(m)
    for bits_, n in ((5, 60), (9, 80), (32, 12)):
        values = [rnd.getrandbits(bits_) << (32 - bits_) for _ in range(n)]
        h = spark.createDataFrame([(10 + 3 * k, [v]) for k, v in enumerate(values)], "file_idx long, words array<long>")
        want = cl.Density(np.array(values, np.uint64)[:, None], m)
        assert cl.joined_edges(spark, cl.dense.collected(h), m - 1) == want.edges
        members, tree = cl.density(h, m)
        got = sorted(tuple(r) for r in members.collect())
        assert got == [(10 + 3 * k, int(g), float(c)) for k, (g, c) in enumerate(zip(want.labels, want.confidence, strict=True))]
        assert [tuple(r) for r in tree.collect()] == want.condensed


def test_density_of_many_hashes(spark):
    h = spark.range(21_000).selectExpr("id as file_idx", "array(shiftleft(pmod(id * 7919, 4096), 20)) as words")
    members, _ = cl.density(h, 3)
    assert members.count() == 21_000


def test_density_of_clear_blobs(spark):
    rnd = random.Random(0)
    centres = [0, 0x0FFF, 0xFF00]
    rows = [[c ^ (1 << rnd.randrange(16))] for c in centres for _ in range(12)]
    found = cl.Density(np.array(rows, np.uint64), 4)
    labels = found.labels.reshape(3, 12)
    assert all(len(set(r) - {-1}) == 1 for r in labels.tolist()) and len(set(found.labels) - {-1}) == 3
    assert ((found.confidence >= 0) & (found.confidence <= 1)).all()
    for n in (0, 1):
        assert (cl.Density(np.array(rows[:n], np.uint64).reshape(n, 1), 4).labels == -1).all()
    with pytest.raises(ValueError):
        cl.Density(np.array(rows, np.uint64), 1)
    _, h = sample(spark, 20)
    members, tree = cl.density(h, 3)
    assert members.count() == 20 and tree.columns == ["parent", "child", "lambda", "child_size"]


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pca_matches_numpy(spark):
    values, h = sample(spark, 30)
    x = np.array([[v >> (N_BITS - 1 - k) & 1 for k in range(N_BITS)] for v in values], float)
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    points, share = projection.pca(h, N_BITS, 3)
    got = np.array([r["point"] for r in points.orderBy("file_idx").collect()])
    for k in range(3):
        sign = np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose(got[:, k], c @ vt[k] * sign)
    assert np.allclose(share, (s**2 / (s**2).sum())[:3])
    assert projection.total_variance(h, N_BITS).first()[0] == pytest.approx(x.var(axis=0).sum())


def test_tsne_keeps_neighbours(spark):
    rows = [(k, [((0xFFF if k % 2 else 0) ^ (1 << (k % 12))) << 20]) for k in range(24)]
    h = spark.createDataFrame(rows, "file_idx long, words array<long>")
    y = {r["file_idx"]: np.array(r["point"]) for r in projection.tsne(h, N_BITS, 2, 5.0, 300, 10.0).collect()}
    near = lambda i: min((np.linalg.norm(y[i] - y[j]), j) for j in y if j != i)[1]
    assert all(near(i) % 2 == i % 2 for i in y)
    p = projection.joint_probabilities(cl.distances(np.array([r[1] for r in rows], np.uint64)).astype(float), 5.0)
    assert p.sum() == pytest.approx(1) and np.allclose(p, p.T)
    with pytest.raises(ValueError):
        projection.project(h, N_BITS, "umap")


def test_tsne_by_blocks_is_that_of_one_machine(spark, monkeypatch):
    _, h = sample(spark, 60)
    one = {r["file_idx"]: r["point"] for r in projection.tsne(h, N_BITS, 2, 8.0, 12, 10.0).collect()}
    monkeypatch.setattr(projection, "ONE_MACHINE", 59)
    many = {r["file_idx"]: r["point"] for r in projection.tsne(h, N_BITS, 2, 8.0, 12, 10.0).collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[i], many[i], rtol=1e-6, atol=1e-12) for i in one)


def test_tsne_by_blocks_reads_the_hashes_once_and_starts_from_pca(spark, monkeypatch):
    _, h = sample(spark, 60)
    h = h.unionByName(h.selectExpr("file_idx + 100 as file_idx", "words"))
    points = projection.dense.collected(h)
    want = {r["file_idx"]: r["point"] for r in projection.pca(h, N_BITS, 2)[0].collect()}
    assert np.allclose(projection._pca_of(points, N_BITS, 2), [want[i] for i in points.idx[points.first].tolist()], rtol=1e-9, atol=1e-12)
    assert projection._pca_of(points, N_BITS, N_BITS + 2).shape == (len(points.first), N_BITS + 2)
    monkeypatch.setattr(projection, "ONE_MACHINE", 59)
    monkeypatch.setattr(projection, "pca", None)  # its plan makes every hash anew for each bit
    assert projection.tsne(h, N_BITS, 2, 8.0, 3, 10.0).count() == 120


@pytest.mark.parametrize("width", [1e-4, 20.0, 2e3])
def test_a_round_of_tsne_meets_all_pairs(width, monkeypatch):
    rng = np.random.default_rng(7)
    codes = np.unique(rng.integers(0, 1 << 16, 900)).astype(np.uint16)[:, None]
    n, weight, d = len(codes), rng.integers(1, 4, len(codes)).astype(float), projection.dense.between(codes, codes).astype(int)
    counts = np.stack([(d == t) @ weight for t in range(17)], axis=1)
    counts[:, 0] -= 1
    share = projection.shares(counts, 5.0) / (2 * weight.sum())
    y = rng.standard_normal((n, 2)) * width
    p = np.take_along_axis(share, d, axis=1) + share.reshape(-1).take(np.arange(n) * 17 + d)
    near = 1 / (1 + sum(np.subtract.outer(y[:, k], y[:, k]) ** 2 for k in range(2)))
    pull, push = np.maximum(p, 1e-12) * near * weight, near * near * weight
    pull, push = (f.sum(axis=1)[:, None] * y - f @ y for f in (pull, push))
    monkeypatch.setattr(projection, "TILE", (30, 70))
    monkeypatch.setattr(projection.dense, "CELLS", 40 * n)
    by_distance, axes, low, high = np.ascontiguousarray(share.T), [np.ascontiguousarray(c) for c in y.T], 100, 351
    once, twice = projection.closeness(y, weight, low, high)
    links = projection.near_links(codes, share, low, high)
    assert sum(len(x[2]) for x in links) == (p[low:high] > 1e-12).sum() < (high - low) * n
    own = y[low:high]
    got = projection.FLOOR * (once[:, :1] * own - once[:, 1:]) + np.concatenate([projection.attraction(axes, weight, by_distance * weight, by_distance, x) for x in links])
    close = lambda a, b: np.allclose(a, b, rtol=1e-7, atol=1e-8 * np.abs(b).max())
    assert close(once[:, 0], (near * weight)[low:high].sum(axis=1)) and close(got, pull[low:high]) and close(twice[:, :1] * own - twice[:, 1:], push[low:high])


def test_removal(spark):
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 5), (3, 5), (4, 5), (5, None)], "file_idx long, group long")
    got = {r["file_idx"]: r["group"] for r in edit.from_groups(members, 1).collect()}
    assert got == {0: None, 1: 5, 2: 5, 3: 5, 4: None}
    assert {r["file_idx"]: r["group"] for r in edit.from_groups(members, 1, min_keep=1).collect()}[0] == 0
    p = spark.createDataFrame([(0, 1, 4), (0, 2, 3), (1, 2, 2)], "i long, j long, d int")
    assert [tuple(r) for r in edit.from_pairs(p, 1).collect()] == [(0, 1, 3)]
    files = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "file_idx long, file string")
    assert edit.index_of(files, "b") == 1
    with pytest.raises(KeyError):
        edit.index_of(files, "x")


def test_votes_and_times(spark):
    frames = spark.createDataFrame([("v", [8 << 28]), ("v", [12 << 28]), ("v", [4 << 28]), ("v", None), ("w", [8 << 28]), ("w", [4 << 28])], "path string, words array<long>")
    got = {r["path"]: (r["words"][0] >> 28, r["n_frames"]) for r in video.majority_vote(frames, 4).collect()}
    assert got == {"v": (12, 3), "w": (0, 2)}
    times = video.frame_times(spark.createDataFrame([("v", 8.0), ("x", 0.0)], "path string, duration double"), 4)
    assert [r["t"] for r in times.orderBy("frame").collect()] == [1.0, 3.0, 5.0, 7.0]
    assert video.sample_indices(10, 4) == [0, 3, 6, 9] and video.sample_indices(2, 5) == [0, 1] and video.sample_indices(0, 3) == []
