"""Nearest neighbours, periodic runs and the conversation trie against brute force, with nulls,
empty tables, ties, repeated rows, hot values and clashing column names."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quarry.llm import common, neighbours, periodic, prefixtrie

# -- nearest neighbours ---------------------------------------------------------------


def _nearest(ids, x, k):
    """{position of a query: its k nearest (-score, id)} by a full search."""
    score = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        score += x[:, j:j + 1] * x[:, j][None]
    return {q: sorted((-score[q, p], ids[p]) for p in range(len(x)) if p != q)[:k] for q in range(len(x)) if ids[q] % 20 == 0}


def _vectors(n, hot):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((12, 16))[rnd.integers(0, 12, n)] + 0.6 * rnd.standard_normal((n, 16))
    x[: hot] = x[0]
    return x.astype(np.float32).astype(float)


def _search(spark, rows, **kw):
    common.ready(spark)
    df = spark.createDataFrame(rows, "id long, v array<double>, key long, cell int, bound double")
    return neighbours.nearest(df, df.filter("id % 20 = 0"), **kw)


def test_neighbours_recall_and_scores(spark):
    n, hot = 2000, 600
    x = _vectors(n, hot)
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = defaultdict(list)
    for r in sorted(_search(spark, [(i, x[i].tolist(), 1, 1, 1.0) for i in range(n)], cell=300).collect()):
        found[r.query_id].append((-r.score, r.id))
    want = _nearest(list(range(n)), x, 20)
    assert {q: len(v) for q, v in found.items()} == {q: 20 for q in want}
    assert all(v == sorted(v) for v in found.values())
    hits = sum(len(set(want[q]) & set(found[q])) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    # one of 600 equal vectors: the neighbours are the 20 smallest ids of the others
    assert [i for _, i in found[0]] == list(range(1, 21)) and [i for _, i in found[20]] == list(range(20))


def test_neighbours_are_exact_when_confidence_is_high(spark):
    x = _vectors(400, 50) * np.linspace(0.2, 3, 400)[:, None]  # inner products, not angles
    found = defaultdict(list)
    for r in sorted(_search(spark, [(i, x[i].tolist(), 1, 1, 1.0) for i in range(400)], cell=60, confidence=1 - 1e-12).collect()):
        found[r.query_id].append((-r.score, r.id))
    assert dict(found) == _nearest(list(range(400)), x, 20)


def test_neighbours_defined_results(spark):
    good = [(i, [float(i + 1), 1.0], 0, 0, 0.0) for i in range(0, 60, 10)]
    odd = [(20, None, 0, 0, 0.0), (40, [0.0, 0.0], 0, 0, 0.0), (60, [1.0, None], 0, 0, 0.0), (80, [float("nan"), 1.0], 0, 0, 0.0),
           (100, [float("inf"), 1.0], 0, 0, 0.0), (120, [1.0, 2.0, 3.0], 0, 0, 0.0), (None, [9.0, 9.0], 0, 0, 0.0)]
    got = sorted(_search(spark, good + odd).collect())
    assert {r.query_id for r in got} == {0, 20, 40} and {r.id for r in got} <= set(range(0, 60, 10))
    assert [r.id for r in got if r.query_id == 20] == [50, 40, 30, 10, 0]
    twice = sorted(_search(spark, good + good[2:3]).collect())  # a repeated row is a neighbour of its twin
    assert [r.id for r in twice if r.query_id == 20] == [50, 40, 30, 20, 10, 0] * 2 or \
        sorted(r.id for r in twice if r.query_id == 20) == sorted([50, 40, 30, 20, 10, 0] * 2)
    assert _search(spark, good[:1]).count() == 0 and _search(spark, []).count() == 0


def test_neighbours_op_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 1, "x") for i in range(1, 50)], "vec_id long, embedding array<float>, rank int, v string")
    out = neighbours.op11(df)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert out.count() == 40
    assert neighbours.op11(df.limit(0)).count() == 0


def test_chi_square_quantiles():
    # tabulated values
    for p, dims, x in ((0.95, 2, 5.991), (0.95, 12, 21.026), (0.5, 10, 9.342), (0.99, 16, 32.0)):
        assert abs(neighbours.chi_square_quantile(p, dims) - x) < 1e-3


def test_cell_boxes_hold_their_points():
    rnd = np.random.default_rng(1)
    p = rnd.standard_normal((500, 4))
    space = neighbours.Space(1.0, rnd.standard_normal((6, 4)), np.array([0, 1, 2, 3, 0, 1, 2]), rnd.standard_normal(7) / 3, 1)
    lo, hi = space.boxes()
    cell = space.cells(p)
    assert len(lo) == 8 and set(cell.tolist()) <= set(range(8))
    assert ((lo[cell] <= p) & (p <= hi[cell])).all()
    assert all(neighbours.box_distance(p[i], lo, hi)[cell[i]] == 0 for i in range(500))


# -- periodic runs -------------------------------------------------------------------------


def _runs(w, shortest):
    """Runs from all periods: stretches of words equal q apart, without multiples of a period."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(shortest, 2 * q):
                out.add((s, i - s + q, q))
            i += 1
    inside = lambda a, b: b[2] < a[2] and a[2] % b[2] == 0 and b[0] <= a[0] and b[0] + b[1] >= a[0] + a[1]
    return sorted((r for r in out if not any(inside(r, o) for o in out)), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        n, letters, shortest = rnd.randint(0, 70), rnd.choice([1, 2, 2, 3, 6]), rnd.choice([2, 5, 7, 12, 12])
        w = [str(rnd.randrange(letters)) for _ in range(n)]
        if n > 10 and rnd.random() < 0.4:
            a = rnd.randrange(n)
            p = 1 + rnd.randrange(max(1, (n - a) // 2))
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        assert periodic.find_runs(w, shortest) == _runs(w, shortest)


def test_runs_of_long_texts():
    assert periodic.find_runs(["a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.find_runs([str(i % 5000) for i in range(60_000)]) == [(0, 60_000, 5000)]
    assert periodic.find_runs([str(i) for i in range(60_000)]) == []


def test_ordered_positions():
    rnd = random.Random(2)
    for _ in range(30):
        own = rnd.sample(range(20_000), rnd.choice([2, 60, 6000]))
        a = periodic.Positions(own[0])
        for x in own[1:-1]:
            a.add(x)
        held = sorted(own[:-1])
        assert list(a) == held and max(map(len, a.blocks)) <= periodic._BLOCK
        x = own[-1]
        assert a.around(x) == (max((h for h in held if h < x), default=-1), min((h for h in held if h > x), default=-1))


PROSE = " ".join(f"w{i * 7919 % 211}" for i in range(150))
TEXTS = [(10, None), (11, ""), (12, " \n"), (13, "one"), (15, "a b " * 30), (15, "a b " * 30), (16, PROSE), (17, PROSE + "\n" + PROSE),
         (21, "x " * 5000), (None, "y z " * 20), (22, "ünï ç\t" * 12), (35, PROSE[:200])] + [(i, PROSE) for i in range(100, 140)]
DOC = "doc_id long, text string, runs int, n_words string, best double, collapsed int"


def _expected(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = _runs(w, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_rows(spark):
    df = spark.createDataFrame([(i, t, 1, "x", 1.0, 2) for i, t in TEXTS], DOC).repartition(3)
    got = periodic.op12(df)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((_expected(*x) for x in TEXTS), key=repr)
    assert any(_expected(*x)[1] and x[1] == PROSE for x in TEXTS)  # an edited tail was found
    assert periodic.op12(df.limit(0)).count() == 0


def test_periodic_against_sql(spark):
    df = spark.createDataFrame([(i, t, 1, "x", 1.0, 2) for i, t in TEXTS if i is not None], DOC)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas().astype({"doc_id": "int64"}))
    want = con.execute(periodic.SQL).fetchall()
    assert sorted(map(tuple, periodic.op12(df).collect()), key=repr) == sorted(want, key=repr)


# -- conversation trie ---------------------------------------------------------------------


def _trie(convs):
    """The trie's rows from {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    rows = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = sum(rows[k][5] for k in kids[node]) or 1
        ends = ",".join(str(c) for c in members[node] if len(convs[c]) == len(node))
        rows[node] = (members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(kids[node]), leaves,
                      own + sum(rows[k][6] for k in kids[node]), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(rows.values(), key=repr)


def _rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def _turns(n, deep):
    rnd = random.Random(5)
    rows = []
    for c in range(100, 100 + n):
        length = rnd.choice([1, 2, 2, 3, 5, 8, deep])
        hot = rnd.random() < 0.4
        for k in range(length):
            text = "hello" if hot and k < 2 else rnd.choice(["yes", "no", None, "", "tell me more", "ü" * 9])
            rows.append((c, None if k == 0 and c % 7 == 0 else k, rnd.choice(["user", "user", None]), text))
    return rows + [(None, 1, "user", "lost")]


TURNS = "conv_id long, turn long, role string, text string, key int, depth string, l int"


@pytest.mark.parametrize("n", [1, 40, 700])
def test_trie_rows(spark, n):
    rows = _turns(n, 30)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS).repartition(3)
    got = prefixtrie.op13(df)
    assert got.dtypes[:8] == [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"),
                              ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == _trie(_rebuilt(rows))


def test_trie_of_an_empty_table(spark):
    assert prefixtrie.op13(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixtrie.op13(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 2)], TURNS)).count() == 0


def test_repeated_rows_are_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "b")]
    got = prefixtrie.op13(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS))
    assert sorted(map(tuple, got.collect()), key=repr) == _trie(_rebuilt(rows))


def test_trie_against_sql(spark):
    rows = [r for r in _turns(200, 12) if r[0] is not None]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "int64"}))
    want = con.execute(prefixtrie.SQL).fetchall()
    assert sorted(map(tuple, prefixtrie.op13(df).collect()), key=repr) == sorted(want, key=repr)


def test_peeling_in_slices_cut_anywhere():
    """Rounds of small slices give the nodes of one slice, and ids of open nodes join in order."""
    rnd = random.Random(9)
    for _ in range(60):
        convs = {c: [("u", rnd.choice("ab") * rnd.randint(1, 2)) for _ in range(rnd.choice([0, 1, 3, 6]))] for c in range(rnd.randint(1, 60))}
        chain = lambda c: b"".join(hashlib.md5(repr(t).encode()).digest() for t in convs[c])
        items = sorted((prefixtrie._Item(chain(c), [len(t) for _, t in convs[c]], c, None, None) for c in convs), key=lambda i: (i.chain, i.conv))
        nodes, parts = [], defaultdict(list)
        while True:
            size = rnd.randint(3, 9)
            last = len(items) <= size
            cut = [items] if last else [items[i: i + size] for i in range(0, len(items), size)]
            again = []
            for piece in cut:
                for row in prefixtrie.peel(piece, last):
                    if row["kind"] == prefixtrie._NODES:
                        nodes.append(row)
                    elif row["kind"] == prefixtrie._ENDS:
                        parts[row["key"]].append((row["conv"], row["ids"]))
                    else:
                        again.append(prefixtrie._Item(row["chain"], row["cps"], row["conv"], row["at"], row["sums"]))
            if last:
                break
            items = again
        by_key = {r["key"]: r for r in nodes}
        assert len(by_key) == len(nodes)
        got = []
        for r in nodes:
            ends = hashlib.sha256(",".join(x for _, x in sorted(parts[r["key"]])).encode()).hexdigest() if r["ends"] is None else r["ends"]
            parent = by_key[r["up"]]["least"] if r["depth"] else None
            assert r.get("parent") in (None, parent)
            got.append((r["least"], r["depth"], parent, r["n"], r["children"], r["leaves"], r["saved"], ends))
        assert sorted(got, key=repr) == _trie(convs)
