"""Conversation repair, whitening and vector near-duplicates against plain Python and numpy, and the rows that real tables hold."""

import collections
import hashlib
import itertools
import math
import zlib
from functools import lru_cache

import numpy as np
import pytest

D = "/root/testdata/sf0.001"
CHAT = "conv_id long, turn long, role string, text string, fp string, at int"
VEC = "vec_id long, embedding array<float>, label int, n int, key string"


# --- conversations -----------------------------------------------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def word_chars(text):
    return [c for c in text if c not in " \t\n\v\f\r"]


def brute_repair(rows):
    """rows: (turn, role, text) in order. All figures of one conversation by a memo over suffixes, on plain tuples and strings."""
    seen, faults = set(), []
    for _, role, text in rows:
        w = word_chars(text)
        faults.append("blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[:1] for _, r, _ in rows]

    def after(q, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((q, c))

    @lru_cache(None)
    def best(i, q, inserted):
        """(cost, letters, output) of rows i.. from the state q."""
        found = []
        if i == len(rows):
            if q in ("", "a"):
                found.append((0, "", ()))
        else:
            extra = 5 * (faults[i] == "truncated")
            c, a, o = best(i + 1, q, 0)
            found.append((c + 2, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                for letter, cost, role in (("K", 0, rows[i][1]), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (nq := after(q, role[:1])) is not None:
                        c, a, o = best(i + 1, nq, 0)
                        found.append((c + cost + extra, letter + a, (f"{role}:{rows[i][2]}", *o)))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (nq := after(q, role[:1])) is not None:
                    c, a, o = best(i, nq, inserted + 1)
                    found.append((c + 5, "I" + a, (f"{role}:", *o)))
        return min(found, key=lambda x: x[:2]) if found else (math.inf, "", ())

    cost, audit, out = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = collections.Counter(faults)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def want_repairs(rows, convs=None):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: brute_repair(sorted(by[c], key=order)) for c in (by if convs is None else convs)}


def chat_rows(seed, n, text="tx."):
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    return [(int(rng.integers(12)), int(rng.integers(6)), pick(["user", "assistant", "system", "user", "assistant", "tool", ""]), pick(["Hi.", "No", "Yes!", " ", "So?\n ", "a b c."])) for _ in range(n)]


def figures(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_row_tables_and_chunk_joins_equal_an_exhaustive_search():
    from locusframe.llm.dialogue import Path, plans, transfer

    rng = np.random.default_rng(3)
    for trial in range(150):
        n = int(rng.integers(1, 5))
        rows = [(i, ["system", "user", "assistant", "tool"][rng.integers(4)], ["x.", "y", " "][rng.integers(3)]) for i in range(n)]
        want = brute_repair(rows)
        seen, kinds = set(), []
        for _, role, text in rows:
            gone = not text.strip() or (role, text) in seen
            seen.add((role, text))
            kinds.append(0 if gone else 1 + 2 * "suat".index(role[0]) + (text == "y"))
        # Every cut into chunks gives the same answer.
        for size in range(1, n + 1):
            path, parts = Path(), [kinds[lo : lo + size] for lo in range(0, n, size)]
            for part in reversed(parts):
                path.add(len(part), transfer(part))
            walked = list(path.walk())
            tail = {0: "", 1: "II", 2: "I", 3: ""}[walked[-1][1]]
            assert (path.ahead[0][0], "".join("".join(s) for _, _, s in walked) + tail) == want[5:7]
            said = [plans(s, slots, part) for (s, _, slots), part in zip(walked, parts, strict=True)]
            assert sum(p.count("D") for x in said for p in x) == want[6].count("D")
        # Plain enumeration of letters: nothing is cheaper, and nothing as cheap is smaller.
        if n <= 2 and trial < 40:
            assert min(_legal(rows, kinds)) == want[5:7]


def _legal(rows, kinds):
    """(cost, letters) of every edit sequence with up to two inserts before each row and at the end."""
    nxt = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    for ops in itertools.product("DKR", repeat=len(rows)):
        for ins in itertools.product(range(3), repeat=len(rows) + 1):
            for roles in itertools.product("ua", repeat=ops.count("R") + sum(ins)):
                q, cost, letters, left = "", 0, "", list(roles)
                for i, op in enumerate((*ops, None)):
                    for c in [left.pop(0) for _ in range(ins[i])]:
                        q, cost, letters = nxt.get((q, c), "x"), cost + 5, letters + "I"
                    if op is None:
                        break
                    if op == "D":
                        cost += 2
                    else:
                        q = "x" if kinds[i] == 0 else nxt.get((q, rows[i][1][0] if op == "K" else left.pop(0)), "x")
                        cost += (op == "R") + 5 * (kinds[i] > 0 and (kinds[i] - 1) % 2)
                    letters += op
                if q in ("", "a"):
                    yield cost, letters


def test_op11_on_the_table_and_odd_rows(spark):
    from locusframe.llm.dialogue import op11_dialogue_repair

    table = spark.read.parquet(f"{D}/conversations.parquet")
    odd = [
        (None, None, None, None), (None, 1, "user", "A."), (None, None, "user", "B."), (7001, 3, None, "x"), (7002, 1, "user", None), (7003, 5, "user", "Same."), (7003, 5, "user", "Same."), (7003, 9, "user", "Same."),
        (7004, 2**62, "user", "Far."), (7004, -(2**62), "assistant", "Near."), (7005, 0, "user", "long " * 50_000 + "."), (7005, 1, "assistant", "é" * 3000 + "?"), (7006, 0, "system", "Only."), (7007, 0, "", ""),
    ]
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()] + odd + [(c + 100, t, r, x) for c, t, r, x in chat_rows(1, 160)]
    got = op11_dialogue_repair(spark.createDataFrame([(*r, "x", 1) for r in rows], CHAT))
    assert [f.dataType.simpleString() for f in got.schema[:7]] == ["bigint"] * 7
    want = want_repairs(damaged(rows), {r[0] for r in rows})
    assert figures(got) == want
    assert op11_dialogue_repair(spark.createDataFrame([], CHAT)).count() == 0
    assert figures(op11_dialogue_repair(table)) == want_repairs(damaged([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]), {r.conv_id for r in table.collect()})


def test_op11_one_conversation_over_many_partitions_and_chunks(spark):
    from locusframe.llm.dialogue import Repair

    rng = np.random.default_rng(5)
    hot = [(1, int(t), ["user", "assistant", "system", "tool"][rng.integers(4)], f"t{rng.integers(400)}{'.!  x'[rng.integers(5)]}") for t in rng.permutation(700)]
    rows = hot + [(2, 0, "user", "Q?"), (2, 1, "assistant", "A."), (0, 0, "system", "S.")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], CHAT)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the partitions apart
    try:
        found = Repair(d, chunk=16)
        assert found.joined.where("conv = '1' and first_at is not null").count() > 40
        want = want_repairs(rows)
        assert figures(found.figures()) == want
        turns = collections.defaultdict(list)
        for r in found.turns().orderBy("position").collect():
            turns[r.conv_id].append((r.role, r.text, r.edit))
        assert {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in turns[c]).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
        assert sum(e == "insert" for x in turns.values() for _, _, e in x) == sum(w[6].count("I") for w in want.values())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# --- whitening ---------------------------------------------------------------------------------------------------------------


def usable(rows):
    return [(i, np.array(e, np.float32).astype(float)) for i, e in rows if e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e)]


def check_whitening(got, rows, tol=1e-7):
    rows = usable(rows)
    x = np.array([np.floor(1024 * e) + 100000 for _, e in rows]).astype(np.int64)
    n, sums = len(x), x.sum(0)
    c = (x * n - sums) / n
    v, q = np.linalg.eigh(c.T @ c / n)
    v, q = v[::-1], q[:, ::-1]
    k = min(8, x.shape[1])
    has = v[:k] > 1e-12 * v.sum()
    w = c @ q[:, :k] / np.where(has, np.sqrt(np.abs(v[:k])), np.nan)
    assert len(got) == n * k
    dev = collections.defaultdict(list)
    for i, (vec, _) in enumerate(rows):
        dev[vec].append(int(((x[i].astype(object) * n - sums.astype(object)) ** 2).sum()))
    by = {(r.vec_id, r.component): r for r in got}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and all(0 <= r.identity_error < 1e-4 for r in got)
    assert all(r.deviation in dev[r.vec_id] for r in got)
    for j in range(k):
        mine = np.array([np.nan if by[i, j + 1].whitened is None else by[i, j + 1].whitened for i, _ in rows])
        assert abs(by[rows[0][0], j + 1].explained - v[j] / v.sum()) <= 1e-4 * v[j] / v.sum() + 1e-12
        if has[j] and len({i for i, _ in rows}) == n:
            assert min(np.abs(mine - w[:, j]).max(), np.abs(mine + w[:, j]).max()) < tol
        if not has[j]:
            assert np.isnan(mine).all()


def test_rank_one_updates_keep_the_spectrum():
    from locusframe.llm.whitening import Spectrum, rank_one

    rng = np.random.default_rng(0)
    blocks = [rng.normal(size=(40, 9)) * 10.0 ** np.arange(9) / 1e4, np.repeat(rng.integers(0, 3, (6, 9)), 5, 0).astype(float), np.ones((20, 9)), rng.normal(size=(3, 9)) + 1e5]
    for rows in blocks:
        for parts in ([rows], [rows[:1], rows[1:]], [rows[i : i + 1] for i in range(len(rows))]):
            s = Spectrum(9)
            for p in parts:
                other = Spectrum(9)
                other.add(p)
                s.merge(other)
            c = rows - rows.mean(0)
            m = c.T @ c
            assert s.n == len(rows) and np.allclose(s.mean, rows.mean(0), rtol=1e-12)
            assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - m).max() < 1e-9 * max(1, np.abs(m).max())
            assert np.abs(s.vectors.T @ s.vectors - np.eye(9)).max() < 1e-10
    # Equal values and entries of zero are deflated.
    d, q = rank_one(np.array([1.0, 1.0, 1.0, 2.0]), np.eye(4), np.array([1.0, 2.0, 0.0, 0.0]))
    assert np.allclose(d, [1, 1, 2, 6]) and np.allclose(q @ np.diag(d) @ q.T, np.diag([1, 1, 1, 2]) + np.outer([1, 2, 0, 0], [1, 2, 0, 0]))


def test_op12_whitening(spark):
    from locusframe.llm.whitening import op12_whitening

    table = spark.read.parquet(f"{D}/embeddings.parquet").repartition(20)  # two levels of the tree
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(op12_whitening(table).collect(), rows)
    odd = [(9001, None), (9002, []), (9003, [1.0, None]), (9004, [math.nan] * 64), (9005, [math.inf] + [0.0] * 63), (9006, [0.0] * 64), (9007, [0.25] * 3), (9008, [1e30] * 64)]
    d = spark.createDataFrame([(*r, 1, 1, "x") for r in rows[:300] + odd], VEC)
    keep = rows[:300] + [odd[5]]
    check_whitening(op12_whitening(d).collect(), keep)
    flat = [(i, [1.0 * (i % 3), 2.0 * (i % 3), 0.5]) for i in range(30)]
    got = op12_whitening(spark.createDataFrame([(*r, 1, 1, "x") for r in flat], VEC)).collect()
    check_whitening(got, flat)
    one = op12_whitening(spark.createDataFrame([(5, [1.0, 2.0], 1, 1, "x"), (5, [1.0, 2.0], 1, 1, "x"), (None, [1.0, 2.0], 1, 1, "x")], VEC)).collect()
    assert len(one) == 6 and {(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(5, 3, 0, None, 0.0, 0.0), (None, 3, 0, None, 0.0, 0.0)}
    assert op12_whitening(spark.createDataFrame([], VEC)).count() == 0


# --- near vectors ------------------------------------------------------------------------------------------------------------


def brute_links(rows, cosine=0.98):
    """rows: (vec_id, embedding, label)."""
    ok = [k for k, (i, e, label) in enumerate(rows) if i is not None and label is not None and e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = [0] * len(rows)
    comp = {rows[k][0]: rows[k][0] for k in ok}

    def top(v):
        while comp[v] != v:
            v = comp[v]
        return v

    v = {k: np.array(rows[k][1], np.float32).astype(float) for k in ok}
    for a, b in itertools.combinations(ok, 2):
        if rows[a][2] == rows[b][2] and len(v[a]) == len(v[b]) and v[a] @ v[b] / math.sqrt((v[a] @ v[a]) * (v[b] @ v[b])) >= cosine:
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(rows[a][0]), top(rows[b][0])))
            comp[y] = x
    own = [top(rows[k][0]) if k in v else rows[k][0] for k in range(len(rows))]
    return collections.Counter((r[0], n, c, r[0] is None or r[0] == c) for r, n, c in zip(rows, links, own, strict=True))


def clustered(seed, n, d=12, labels=2):
    """A dense group of near copies, chains near the bound, exact copies and noise."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=d)
    out = [(i, (centre + rng.normal(size=d) * 0.06).tolist(), 1) for i in range(n)]
    base = rng.normal(size=d)
    for i in range(n, 2 * n):
        base = base + rng.normal(size=d) * 0.17
        out.append((i, (base * (1 + i)).tolist(), int(i % labels)))
    out += [(i, rng.normal(size=d).tolist(), int(rng.integers(labels))) for i in range(2 * n, 3 * n)]
    out += [(3 * n + i, out[5][1], 1) for i in range(7)]
    return out


def linked(df):
    return collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("shape", [{}, {"cell_rows": 20, "block": 4096, "pivots": 4, "sample": 64}, {"cell_rows": 30, "block": 16, "pivots": 3, "sample": 40}, {"cell_rows": 15, "block": 64, "levels": 3, "pivots": 5}, {"levels": 0, "block": 25}])
def test_op13_equals_all_pairs(spark, shape):
    from locusframe.llm.vector_dedup import near_vectors

    odd = [(None, [1.0] * 12, 1), (8001, None, 1), (8002, [], 1), (8003, [0.0] * 12, 1), (8004, [math.nan] * 12, 1), (8005, [1.0] * 12, None), (8006, [1.0] * 12, 1), (8006, [2.0] * 12, 1), (8007, [1.0] * 3, 1), (8008, [1e30] * 12, 1), (8009, [1e-30] * 12, 1), (8010, [None] * 12, 1), (-5, [1.0] * 12, 1)]
    rows = clustered(7, 90) + odd
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], VEC)
    assert linked(near_vectors(d, **shape)) == brute_links(rows)
    assert near_vectors(spark.createDataFrame([], VEC), **shape).count() == 0


def test_op13_on_the_table(spark):
    from locusframe.llm.vector_dedup import near_vectors

    table = spark.read.parquet(f"{D}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert linked(near_vectors(table)) == linked(near_vectors(table, cell_rows=10, block=32, pivots=4)) == brute_links(rows)
