"""Source mixing, ranked lexical search and vector codes against plain versions, on provided and on odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from comparing import of_spark, of_sql
from pyspark.sql import functions as F

from sparkway.llm import codes, lexical, mixing, queries, skew

Q, SQL = queries.queries(), queries.oracle_sql()
DOCS = "doc_id long, text string, source string, size long, rank int, slot int, mark long, target string, term int, terms string"


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "a b c", "the The THE ﬁ Straße İ x-1 x1", "\x00 nul \x7f", "🙂 a🙂b", "z" * 30_000]
    texts += [" ".join(rng.choice(["the", "of", "Haus", "Ünit", "x1", "stone"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    rows = [(k, t, rng.choice(["b", "a", "a", "a", "é", "Z", None, ""])) for k, t in enumerate(texts)]
    return [*rows, *[(3, "three equal words", "a")] * 7, (3, "other", "a"), (None, "no id here", "b"), (None, None, None), (-4, "word " * 9000, "small"), (5, "", "void")]


def odd(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], DOCS).repartition(parts)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- mixing -----------------------------------------------------------------------------------


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target}: shares by weight, what is over ``most`` times a source going to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: Fraction(left * weigh[s], sum(weigh[t] for t in open_)) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in order}
        full |= over


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return signed(h)


def plain_mix(rows):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source)."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    goal = targets(sizes)
    taken = Counter()
    for source in sizes:
        mine = [(k, i, len(words(t)), hashed("mix", i, t or "")) for k, (i, t, s) in enumerate(rows) if s == source]
        left, epoch = math.floor(goal[source]), 0
        while left > 0:
            for k, _, size, _ in sorted(mine, key=lambda m: (hashed(epoch, m[3], m[1], m[2]), m[3], m[1] is not None, m[1] or 0)):
                n = min(size, left)
                taken[k] += n
                left -= n
            epoch += 1
    return [(i, len(words(t)), sizes[s], goal[s], taken[k]) for k, (i, t, s) in enumerate(rows)]


def as_mixed(rows):
    return sorted(((r[0] is None, r[0] or 0), r[1], r[2], round(float(r[3]), 6), r[4]) for r in rows)


def by_document(rows, schedule):
    taken = schedule.groupBy("row_id", "source").agg(F.sum("n_words").alias("taken"))
    return rows.join(taken.withColumnsRenamed({"row_id": "r", "source": "s"}), F.col("row_id").eqNullSafe(F.col("r")) & F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)))


def test_mixing(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = Q["op11_mixing"](spark, data).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert as_mixed(got) == as_mixed(plain_mix(rows))


@pytest.mark.parametrize(("run", "sent", "ranges"), [(65_536, 300_000, 65_536), (2, 0, 5)])
def test_mixing_odd(spark, odd_rows, monkeypatch, run, sent, ranges):
    monkeypatch.setattr(skew, "RUN", run)
    monkeypatch.setattr(skew, "MOST_SENT", sent)
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    want = as_mixed(plain_mix(odd_rows))
    for parts in (1, 4):
        rows, schedule = mixing.mixed(odd(spark, odd_rows, parts), block_words=50)
        assert as_mixed(by_document(rows, schedule).collect()) == want
    # every slot of the schedule is a whole block but for each source's last one, and slots of a source are evenly spread
    taken = schedule.groupBy("source", "slot", "rank").agg(F.sum("n_words").alias("n")).collect()
    goal = targets(Counter({s: sum(len(words(t)) for _, t, z in odd_rows if z == s) for s in {r[2] for r in odd_rows}}))
    slots = sum(-(-math.floor(t) // 50) for t in goal.values())
    assert len({r["slot"] for r in taken}) == len(taken) == slots
    time = {r["slot"]: k for k, r in enumerate(sorted(taken, key=lambda r: r["slot"]))}
    for source, t in goal.items():
        mine = sorted((r["slot"], r["rank"], r["n"]) for r in taken if r["source"] == source)
        assert [m[1] for m in mine] == list(range(-(-math.floor(t) // 50)))
        assert all(m[2] == 50 for m in mine[:-1]) and sum(m[2] for m in mine) == math.floor(t)
        assert all(abs(k - time[m[0]] * len(mine) / slots) <= 2 + math.log2(slots) for k, m in enumerate(mine))


def test_mixing_of_nothing(spark):
    rows, schedule = mixing.mixed(spark.createDataFrame([], DOCS))
    assert rows.count() == schedule.count() == 0
    rows, schedule = mixing.mixed(odd(spark, [(1, None, "a"), (2, "", None)]))
    assert [(r["size"], r["target"]) for r in rows.collect()] == [(0, 0.0)] * 2 and schedule.count() == 0


def test_targets_refill(spark):
    sizes = {"a": 1, "b": 1000, "c": 2, "d": 10, "e": 5, "f": 100}
    table = spark.createDataFrame([(s, n, k % 3 + 1) for k, (s, n) in enumerate(sorted(sizes.items()))], "source string, source_size long, weight long")
    got = {r["source"]: r["target"] for r in mixing.shared(table, 3).collect()}
    assert got == pytest.approx({s: float(t) for s, t in targets(sizes).items()})


# -- lexical search ---------------------------------------------------------------------------


def terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in asked.items() if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def keyed(rows):
    return sorted(tuple((x is None, x or 0) for x in r) for r in rows)


def test_lexical_matches_sql(spark, data):
    assert of_spark(Q["op12_lexical"](spark, data)) == of_sql(SQL["op12_lexical"], data)


@pytest.mark.parametrize("size", [lexical.PASS_BYTES, 100])
def test_lexical_odd(spark, odd_rows, monkeypatch, size):
    monkeypatch.setattr(lexical, "PASS_BYTES", size)
    monkeypatch.setattr(lexical, "MERGED", 2)
    items = [(1, "the stone"), (2, "THE the the x1 x1"), (3, None), (4, ""), (5, "nowhere"), (None, "haus Haus"), (6, "🙂 a🙂b Ünit"), (6, "other three"), (2, "THE the the x1 x1"), (7, "z" * 30_000 + " word id")]
    table = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, rank int")
    pairs = [r[:2] for r in odd_rows]
    for k in (1, 4, 500):
        got = lexical.search(odd(spark, odd_rows), table, k=k, block_rows=17).collect()
        assert keyed(map(tuple, got)) == keyed(plain_search(pairs, items, k))
    assert lexical.search(odd(spark, []), table).count() == 0
    assert lexical.search(odd(spark, odd_rows), table.limit(0)).count() == 0


def test_sliced_sums_and_tops():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 17):
        values = rng.integers(0, 1 << 20, (n, 130))
        slices = lexical.added(np.stack([lexical.sliced(v, 3, 26) for v in values]))
        total = values.sum(axis=0)
        assert lexical.values_at(slices, np.arange(130)).tolist() == total.tolist()
        for k in (1, 5, 200):
            assert sorted(lexical.top(slices, k).tolist()) == sorted(sorted(range(130), key=lambda i: (-total[i], i))[:k])
    tied = lexical.sliced(np.array([3, 0, 3, 1, 3]), 1, 3)
    assert sorted(lexical.top(tied, 2).tolist()) == [0, 2] and sorted(lexical.top(tied, 9).tolist()) == [0, 2, 3, 4]


# -- vector codes -----------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    """([(vec_id, code, error)], codebooks) of rows (vec_id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(q) for _, q in kept), default=0) // parts) * parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda q: [np.array(p) for p in np.split(np.array([*q, *[0] * (width - len(q))], np.int64), parts)]
    vectors, books = [cut(q) for _, q in kept], [list(b) for b in zip(*[cut(q) for _, q in first], strict=True)]
    nearest = lambda v, book: min((int(((v - c) ** 2).sum()), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts if kept else 0):
            mine = [nearest(v[p], books[p])[1] for v in vectors]
            books[p] = [np.sum([v[p] for v, m in zip(vectors, mine, strict=True) if m == e], axis=0) // mine.count(e) if e in mine else c for e, c in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in vectors]
    return [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found, strict=True)], books


def test_codes_match_sql(spark, data):
    assert of_spark(Q["op13_codes"](spark, data)) == of_sql(SQL["op13_codes"], data)


@pytest.mark.parametrize(("entries", "long", "scale"), [(5, 16, 1024), (256, 10, 8), (1, 3, 1024), (7, 1, 3)])
def test_codes_odd(spark, entries, long, scale):
    rng = random.Random(entries)
    vectors = [[rng.gauss(0, 1) for _ in range(long)] for _ in range(80)]
    vectors += [None, [], [None] * long, [float("nan")] * long, [*[0.5] * (long - 1), float("inf")], *[[0.25] * long] * 9, [rng.random()] * max(1, long // 2), [-1000.0] * long]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[0]), (3, vectors[0]), (None, vectors[1]), (-5, vectors[2])]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, v, "c", k % 3) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, code string, error int").repartition(3)
    got, books = codes.coded(table, "vec_id", "embedding", scale=scale, entries=entries, rounds=3)
    want, plain = plain_codes(rows, 4, entries, 3, scale)
    assert keyed(map(tuple, got.collect())) == keyed(want)
    assert codes.codebooks_sha256(books) == codes.codebooks_sha256([np.array(b) for b in plain])


def test_codes_of_nothing(spark):
    got, books = codes.coded(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.count() == 0 and books == []


def test_bounds_keep_the_nearest():
    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 16, 33):
        entries = rng.integers(-9, 9, (200, width)) * rng.integers(1, 10_000)
        entries[50:60] = entries[40:50]
        x = np.concatenate((entries[::7], rng.integers(-90_000, 90_000, (300, width)), entries[::3] + 1))
        table = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        chosen, distance = codes.Codebook(entries).nearest(x)
        assert chosen.tolist() == table.argmin(axis=1).tolist() and distance.tolist() == table.min(axis=1).tolist()


@pytest.mark.parametrize("sent", [0, 300_000])
def test_facts_of_hot_keys(spark, monkeypatch, sent):
    monkeypatch.setattr(skew, "MOST_SENT", sent)
    monkeypatch.setattr(skew, "HOT_SHARE", 3)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else (None if k % 3 == 0 else f"k{k}")) for k in range(60)], "id long, name string")
    facts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    got = {r["id"]: (r["name"], r["n"], r["total"]) for r in skew.with_facts(rows, facts, "name", "n").collect()}
    held = rows.collect()
    want = {r["id"]: (r["name"], sum(s["name"] == r["name"] for s in held), sum(s["id"] for s in held if s["name"] == r["name"])) for r in held}
    assert got == want
