"""Vector codes, near copies of embeddings and the source audit against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.duck import DATA, check
from tilth.llm import embedding_dedup, source_audit, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int"


def _rows(spark, rows, schema=VECTORS):
    return spark.createDataFrame(rows, schema)


# --- vector codes


def _plain_codes(rows):
    """Lloyd in Python integers: {vec_id: (code, error)}, label sums and the hash."""
    kept = [(i, e, label) for i, e, label in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = max(len(e) for _, e, _ in kept)
    width += -width % 4
    x = [[int(np.floor(1024 * v)) for v in e] + [0] * (width - len(e)) for _, e, _ in kept]
    size = width // 4
    parts = [[r[p * size : (p + 1) * size] for r in x] for p in range(4)]
    books = [[r[:] for r in part[:256]] for part in parts]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    for turn in range(5):
        near = [[min(range(len(book)), key=lambda k: (far(r, book[k]), k)) for r in part] for part, book in zip(parts, books)]
        if turn == 4:
            break
        for p, part in enumerate(parts):
            own = defaultdict(list)
            for r, k in zip(part, near[p]):
                own[k].append(r)
            for k, rs in own.items():
                books[p][k] = [sum(c) // len(rs) for c in zip(*rs)]
    out, by_label = [], Counter()
    for n, (i, _, label) in enumerate(kept):
        error = sum(far(parts[p][n], books[p][near[p][n]]) for p in range(4))
        out.append((i, "".join(f"{near[p][n]:02x}" for p in range(4)), error, label))
        by_label[label] += error
    told = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((i, code, error, by_label[label], told) for i, code, error, label in out)


def test_codes_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(300, 8))
    rows = [(int(i), [float(v) for v in np.round(centre[rng.integers(300)] + 0.05 * rng.normal(size=8), 2)], int(rng.integers(3)) if i % 7 else None) for i in rng.permutation(420)]
    rows += [(500, rows[3][1], 1), (500, rows[3][1], 1), (501, [0.5] * 8, None), (502, None, 1), (503, [None] + [0.1] * 7, 1), (504, [float("nan")] * 8, 1), (505, [float("inf")] * 8, 0)]
    got = vector_codes.encode(_rows(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect())) == _plain_codes(rows)


def test_ties_go_to_the_lower_entry_and_short_vectors_are_filled_up(spark):
    rows = [(i, [float(i % 3)] * 6, 0) for i in range(20)] + [(20, [1.0], 0), (21, [], 0)]
    got = vector_codes.encode(_rows(spark, rows))
    assert sorted(map(tuple, got.collect())) == _plain_codes(rows)


def test_bounds_spare_scans(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    state, _, _ = vector_codes.train(rows)
    whole = vector_codes.PARTS * rows.count()
    assert 0 < state.agg(F.sum("scans")).first()[0] < 0.9 * whole


def test_codes_of_no_rows_and_of_clashing_columns(spark):
    assert vector_codes.encode(_rows(spark, [])).collect() == []
    assert vector_codes.encode(_rows(spark, [(1, None, 2)])).collect() == []
    wide = _rows(spark, [(None, [0.5] * 4, 2), (1, [1e30] * 4, 2)]).withColumns({c: F.lit("x") for c in ("x", "entry", "code", "error", "of", "label_error")})
    got = sorted(vector_codes.encode(wide).collect(), key=str)
    assert [r["code"] for r in got] == ["00000000", "01010101"] and all(r["error"] == 0 for r in got)


# --- near copies of embeddings


def _plain_links(rows, threshold):
    ids, unit = [r[0] for r in rows], []
    width = max((len(r[1]) for r in rows if r[1]), default=0)
    for _, e, *_ in rows:
        fine = e is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)
        v = np.array(list(e) + [0.0] * (width - len(e))) if fine else np.full(width, np.nan)
        unit.append(v / np.sqrt((v * v).sum()))
    cos = np.nan_to_num(np.array(unit) @ np.array(unit).T, nan=-1.0)
    near = cos >= threshold - 1e-12
    np.fill_diagonal(near, False)
    links = near.sum(1).tolist()
    comp = list(ids)
    while True:
        after = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        by_id = {}
        for i, c in zip(ids, after):
            by_id[i] = min(c, by_id.get(i, c))
        after = [by_id[i] for i in ids]
        if after == comp:
            return sorted(zip(ids, links, comp, [i == c for i, c in zip(ids, comp)]))
        comp = after


def _groups(seed, n, dim, groups, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    own = np.minimum(rng.integers(groups, size=n), rng.integers(groups, size=n))
    own[: n // 3] = 0  # one group has a third of all
    v = centre[own] + spread * rng.normal(size=(n, dim)) * rng.random((n, 1))
    v[5] = v[6] = 2 * v[7]
    return [(int(i), [float(c) for c in x], 0) for i, x in zip(rng.permutation(n), v)]


@pytest.mark.parametrize("seed,dim,spread,block,slow", [(1, 16, 0.3, 2048, False), (2, 4, 0.3, 32, False), (3, 24, 0.15, 16, True), (4, 3, 0.6, 64, True)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, seed, dim, spread, block, slow):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    if slow:  # more cells than vectors call for
        monkeypatch.setattr(embedding_dedup.math, "ceil", lambda x, ceil=embedding_dedup.math.ceil: 4 * ceil(x))
    rows = _groups(seed, 600, dim, 40, spread)
    got = embedding_dedup.near_copies(_rows(spark, rows).repartition(4))
    want = _plain_links(rows, 0.95)
    assert sorted(map(tuple, got.collect())) == want
    assert max(w[1] for w in want) > 100


def test_near_copies_keep_odd_vectors_apart(spark):
    far = [1.0, 0.0, 0.0]
    rows = [(1, far, 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [], 0), (6, [None, 1.0, 0.0], 0), (7, [float("nan"), 1.0, 0.0], 0), (8, [float("-inf"), 1.0, 0.0], 0)]
    rows += [(9, [0.95, (1 - 0.95**2) ** 0.5, 0.0], 0), (10, [1e-300, 0.0, -0.0], 0), (11, [1e300, 0.0, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_copies(_rows(spark, rows)).collect()}
    assert {i: got[i] for i in (3, 4, 5, 6, 7, 8)} == {i: (0, i) for i in (3, 4, 5, 6, 7, 8)}
    assert {got[i][1] for i in (1, 2, 10, 11)} == {1} and got[2] == got[10] == got[11]
    assert got[1][0] in (3, 4)


def test_near_copies_of_repeated_and_null_ids(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0), (None, [1.0, 1.0], 0), (4, [1.0, 1.0], 0)]
    got = sorted(map(tuple, embedding_dedup.near_copies(_rows(spark, rows).withColumns({"doc": F.lit(1), "rep": F.lit(2), "cell": F.lit(3), "h1": F.lit(1)})).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 1, None, True), (4, 1, None, False)], key=str)
    assert embedding_dedup.near_copies(_rows(spark, [])).collect() == []
    assert [tuple(r) for r in embedding_dedup.near_copies(_rows(spark, [(7, None, 1)])).collect()] == [(7, 0, 7, True)]


# --- source audit


def _plain_audit(docs):
    docs = [tuple(x or "" for x in d) for d in docs]
    words = [re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.encode().lower()) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(d[2], w) for d, w in zip(docs, words) if d[1] == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= 3)
        count = {s: Counter() for s, _ in own}
        for s, w in own:
            count[s].update(t for t in w if df[t] >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            top = [((p[s][t] - q[t]) ** 2 // q[t], t.decode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", top)):
                ranked = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < 200]
    return sorted(out)


def _audited(spark, docs):
    return sorted(map(tuple, source_audit.audit(spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("block,piece,held", [(4096, 1 << 20, 1 << 19), (7, 16, 20)])
def test_audit_is_that_of_plain_counting(spark, monkeypatch, block, piece, held):
    for name, value in (("BLOCK", block), ("PIECE", piece), ("HELD", held)):
        monkeypatch.setattr(source_audit, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Über", "über", "日本", "x1y", "Don't"]
    pick = lambda n: " ".join(words[min(int(rng.exponential(40)), len(words) - 1)] for _ in range(n))
    docs = [(pick(int(rng.integers(1, 60))), str(rng.choice(["en", "de"])), f"s{int(rng.integers(5))}") for _ in range(120)]
    docs += [(None, "en", "s1"), ("", "en", "only"), ("rare", "xx", "a"), (None, None, None), ("one two", "xx", None), ("one one", "", "b"), (docs[0][0], *docs[0][1:]), (pick(4000), "en", "long")]
    assert _audited(spark, docs) == _plain_audit(docs)


def test_audit_of_no_rows_and_shares_of_large_counts(spark):
    assert _audited(spark, []) == []
    assert _audited(spark, [("a b", "en", "x")]) == []
    count, total = np.array([0, 5, 10**12, 7 * 10**14]), np.array(7 * 10**14 + 5)
    assert source_audit.shares(count, total).tolist() == [1 + 10**9 * (c + 1) // int(total) for c in count.tolist()]
    assert source_audit.shares(np.array([6]), np.array(7)).tolist() == [10**9 + 1]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_embedding_dedup", "op13_source_audit"])
def test_new_queries_against_sql(spark, name):
    from tilth.llm import queries

    check(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), queries.ORACLE_SQL[name], "sf0.001")
