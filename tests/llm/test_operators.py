"""The dealt operators against brute force: provided rows, and odd rows (nulls, repeats, long texts, clashing names)."""

from __future__ import annotations

import random
import zlib

import brute
import pytest
from comparing import of_spark, of_sql
from public_tokenizers import path as vocabulary_path

from sparkway.llm import bpe, decontaminate, langid, licenses, lm, pii, queries, sharding, simhash, substrings, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket int, key string, fp long, n long, pii string, verdict string, text_key string, arc int, slice int, root long, space int, target boolean, rank int"
Q = queries.queries()


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "Haus", "été", "ñandú", "x1", "a", "licence", "river", "stone"]) + rng.choice(["", "s", "ing"])
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n\t", "one", "Straße ΑΣ Σ ﬁ ① ٣ 　 é", "\u0085\u001c  a b", passage, passage, passage + " tail", "x " + passage, "\x00 nul", "🙂 🙂👍🏽 é", "<|endoftext|> end"]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    texts += [" ".join(word() for _ in range(60_000)), "a" * 20_000, ("same words again " * 50).strip()]
    texts += ["CC-BY cc by, General Public\nLicense. All rights reserved; all rights reserved", "gpl general public license 3 is licensed under the Apache License, Version 2.0"]
    texts += ["Mail a.b@x.org,a@b@c.de or 10.0.0.256 10.1.2.3.4 1.2.3.4 +49 (170) 123-4567 4111 1111 1111 1111 and 4111111111111112", "1234567890123456789012 @ + a@b..c 0000.1.1.1"]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, (3, "one"), (3, "one"), (3, "other text"), (None, passage), (None, None), (-7, "negative id"), (1 << 60, passage)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, *[None] * 17) for i, t in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark, data):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def test_substrings(spark, data, given, odd, odd_rows, empty):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    same(Q["op3_substrings"](spark, data).select(*columns).collect(), brute.repeats(given))
    parsed = substrings.parse(odd, block_bytes=50_000, bucket_entries=500).collect()
    same([(r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept_text"])) for r in parsed], brute.repeats(odd_rows))
    assert any(f["source"] == 6 for r in parsed for f in r["factors"])
    w = [f"w{k}" for k in range(60)]
    rng = random.Random(4)
    cut = lambda a: w[a : a + rng.randrange(5, 40)]
    pieces = [(k, " ".join(x for _ in range(rng.randrange(1, 5)) for x in cut(rng.randrange(45)))) for k in range(60)]
    three = [(1, " ".join(w[10:23])), (2, " ".join(w[:40])), (3, " ".join(w[:40]))]
    for rows in (given, three, pieces):
        found = substrings.parse(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_bytes=2000, bucket_entries=500).collect()
        assert {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in found} == brute.parse(rows)
    assert [tuple(f) for f in brute.parse(three)[3]] == [(0, 40, 2)]
    assert substrings.parse(empty).count() == 0


def test_bpe(spark, data, given, odd, odd_rows, empty):
    path = vocabulary_path("word_bpe_49k.json")
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    same(Q["op4_bpe"](spark, data).select(*columns).collect(), brute.tokens(given, path))
    coded = bpe.decode(bpe.encode(odd, path=path), path=path).collect()
    same([(r["doc_id"], r["n_tokens"], brute.sha(bytes(r["ids"])), brute.sha(r["decoded"])) for r in coded], brute.tokens(odd_rows, path))
    assert sorted(map(tuple, coded), key=str) == sorted(map(tuple, bpe.coded(odd, path=path).collect()), key=str)
    assert bpe.decode(bpe.encode(empty, path=path), path=path).count() == 0


def test_bpe_of_long_words():
    import time

    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), bpe.vocabulary(path)
    rng = random.Random(7)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("abcdefghijklmnopqrstuvwxyz", 4000), ("etaoin", 3000), ("ACGT", 5000), ("aé", 900), ("z", 700), ("ab", 513), ("the", 512))]
    texts += ["ab" * 3000, "the" * 2000 + " " + "ing" * 600 + " short words " + "x" * 511, "word " * 50 + "".join(rng.choice("ést") for _ in range(2000))]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
    began = time.process_time()
    (ids,) = ours.encode(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))])
    assert len(ids) > 100_000 and time.process_time() - began < 3


def test_simhash(spark, data, given, odd, odd_rows, empty):
    same(Q["op7_simhash"](spark, data).select("doc_id", "fingerprint", "component_id").collect(), brute.simhash_classes(given))
    found = simhash.near_duplicates(odd, shingle=3, group_limit=4).collect()
    same([(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found], brute.simhash_classes(odd_rows))
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_in_dense_fingerprints(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(0, signed(x)) for x in prints], "space int, fp long")
    for limit in (10, 20_000):
        pairs = simhash.links(frame, group_limit=limit).collect()
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, group_limit=limit).drop("space")).collect()}
        assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3 for r in pairs)
        groups, want = {}, {}
        for x, r in brute.classes(prints).items():
            want.setdefault(r, set()).add(x)
            groups.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("together", [9, 1000])
def test_near_copies(spark, empty, together):
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(k, t) for k, t in enumerate([None, "", "solo", " ".join(base), " ".join(base)])]
    for k in range(60):
        copy = [w if rng.random() > 0.02 else f"v{rng.randrange(400)}" for w in base]
        rows.append((10 + k, " ".join(copy)))
    rows += [(100 + k, " ".join(f"u{rng.randrange(5000)}" for _ in range(80))) for k in range(20)] + [(12, rows[7][1]), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text_key"]): r["kept_id"] for r in simhash.near_copies(frame, together=together).collect()}
    import hashlib

    want = {(i, hashlib.md5(t.encode()).hexdigest()): j for (i, t), j in brute.near_classes(rows).items()}
    assert got == want
    assert simhash.near_copies(empty).count() == 0


def test_near_copies_of_a_whole_table(spark, data):
    from pathlib import Path

    larger = Path(data).parent / "sf0.01"
    docs = spark.read.parquet(f"{larger if larger.exists() else data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {i: j for (i, _), j in brute.near_classes(rows).items()}
    got = {r["doc_id"]: r["kept_id"] for r in simhash.near_copies(docs).collect()}
    assert got == want and any(i != j for i, j in want.items())


def test_near_copies_of_a_large_family(spark):
    """10,000 near copies of one text make one class, dealt over many tasks; a text beside them stays alone."""
    rng = random.Random(23)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: (at := rng.randrange(110))], f"v{k}", *base[at:]])) for k in range(10_000)] + [(60_000, " ".join(base[:40])), (60_001, " ".join(base))]
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert {(r["kept_id"], r["n"]) for r in found.groupBy("kept_id").agg({"*": "count"}).toDF("kept_id", "n").collect()} == {(0, 10_001), (60_000, 1)}
    assert sorted(r["doc_id"] for r in found.where("stays").collect()) == [0, 60_000]


def test_near_copies_after_block_edits(spark):
    """Every near pair by brute force meets, whatever the edit: recall by kind of edit and similarity."""
    rng = random.Random(17)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    passage = lambda n: [word() for _ in range(n)]
    boilerplate, rows, kinds = passage(40), [], {}
    for k in range(160):
        kind, n, share = ("replaced", "appended", "cut", "inserted")[k % 4], rng.randrange(60, 400), rng.uniform(0.02, 0.18)
        base = passage(n) + (boilerplate if k % 3 == 0 else [])
        edit = max(1, int(share * len(base)))
        spot = rng.randrange(len(base))
        if kind == "replaced":
            copy = [word() if rng.random() < share / 8 else w for w in base]
        else:
            copy = {"appended": base + passage(edit), "cut": base[:-edit], "inserted": base[:spot] + passage(edit) + base[spot:]}[kind]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        kinds[2 * k + 1] = kind
    want = {i: j for (i, _), j in brute.near_classes(rows).items()}
    got = {r["doc_id"]: r["kept_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    found = {kind: [got[i] == want[i] for i, k in kinds.items() if k == kind and want[i] != i] for kind in ("replaced", "appended", "cut", "inserted")}
    recall = {kind: f"{sum(met)} of {len(met)}" for kind, met in found.items()}
    print(recall)
    assert all(len(met) >= 15 and all(met) for met in found.values()), recall
    assert got == want


def test_licences(spark, data, given, odd, odd_rows, empty):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(Q["op9_licenses"](spark, data).select(*columns).collect(), brute.licences(given))
    found = licenses.scan(odd).collect()
    same([(r["doc_id"], r["n_words"], len(r["places"])) for r in found], [w[:3] for w in brute.licences(odd_rows)])
    assert any(s["label"] == "apache-2.0" for r in found for s in r["spans"])
    texts = [(k, f"x y z {t} and so on") for k, (_, t) in enumerate(licenses.TEMPLATES)] + [(90, "released as WTFPL here"), (91, "a b c a b c a b d"), (92, "q c a b d")]
    scanned = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), phrases=(*licenses.BASE_PHRASES, ("wtfpl", "wtfpl"))).collect()}
    for k, (label, text) in enumerate(licenses.TEMPLATES):  # every template in a text is a whole span
        n = len(licenses.words_of(text.encode()))
        assert (label, 3, 3 + n, 1.0) in {tuple(s) for s in scanned[k]["spans"]}
    assert [tuple(p) for p in scanned[90]["places"]] == [(2, "wtfpl")]
    chained = licenses.scan(spark.createDataFrame(texts[-2:], "doc_id long, text string"), templates=(("abc", "a b c a b d"),), min_match=2).collect()
    assert {(r["doc_id"], tuple(s)) for r in chained for s in r["spans"]} == {(91, ("abc", 0, 9, 1.0)), (92, ("abc", 1, 5, 4 / 6))}
    assert licenses.scan(empty).count() == 0


def test_personal_data(spark, data, given, odd, odd_rows, empty):
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    same(Q["op10_pii"](spark, data).select(*columns).collect(), brute.personal_rows(given))
    kinds = ("email", "ip", "card", "phone")
    found = pii.sanitise(odd, into="found").collect()
    same([(r["doc_id"], [(s["start"], s["kind"], s["end"]) for s in r["found"]["spans"] if s["kind"] != "term"]) for r in found], [(i, [(a, kinds[k], z) for a, k, z in brute.personal(t)]) for i, t in odd_rows])
    assert all((r["found"]["clean_text"] is None) == (r["text"] is None) for r in found)
    assert pii.sanitise(empty).count() == 0


def test_disclosing_terms_by_hand(spark):
    """Every term and threshold from plain counts."""
    import math
    from collections import Counter

    import xxhash

    rng = random.Random(9)
    names = ["anna", "bert", "cleo", "dora"]
    texts = [f"{rng.choice(names)} or {rng.choice(names)} wrote {rng.choice(names)}{k % 5}@mail.org on day {rng.choice(['one', 'two', 'three'])}" if k % 3 else " ".join(rng.choice([*names, "day", "one", "wrote", "or", "rain", "on"]) for _ in range(12)) for k in range(90)]
    near, seen, total = Counter(), {}, Counter()
    for text in texts:
        spans = brute.personal(text)
        at = [(a, z) for a, _, z in spans]
        w = [m for m in pii.WORD.finditer(text) if not any(m.start() < z and a < m.end() for a, z in at)]
        total.update(m.group().lower() for m in w)
        for a, kind, z in spans:
            value = xxhash.xxh3_64_intdigest(text[a:z]) >> 1
            for m in [*[m for m in w if m.end() <= a][-6:], *[m for m in w if m.start() >= z][:6]]:
                near[m.group().lower(), kind, value] += 1
                seen.setdefault((m.group().lower(), kind, value), set()).add(text)
    want, words = set(), sum(total.values())
    for value in {None, *(v for _, _, v in near)}:
        mine = Counter()
        for (t, c, v), n in near.items():
            if value in (None, v):
                mine[t, c] += n
        ic = -math.log(sum(mine.values()) / words)
        for (t, c), n in mine.items():
            enough = len({v for x, y, v in near if (x, y) == (t, c)}) >= 3 if value is None else len(seen[t, c, value]) >= 3
            if enough and math.log(min(1.0, n / total[t])) + ic >= ic / 1.25 - 1e-12:
                want.add((t, c, value))
    got = {(r["term"], r["kind"], r["value"]) for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == want and want


def test_many_addresses_in_one_text():
    import time

    text = " ".join(f"person{k}@host{k}.org wrote a line" for k in range(4000))
    began = time.process_time()
    assert len(pii.contexts(text, pii.patterns(text), 6, 100)) > 4000
    assert time.process_time() - began < 2


def test_terms_that_disclose(spark):
    rows = [(k, f"write to codename{'x' if k % 2 else 'y'} via person{k}@host.org now and read the common words here") for k in range(40)] + [(100 + k, "the common words here are now to read and write via other ways") for k in range(200)]
    rows += [(300 + k, f"dear Zimmer please answer zimmer@host.org or leave a note {k} times") for k in range(5)] + [(400, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own_key", "2 AS own_terms")
    found = pii.sanitise(frame).orderBy("doc_id").collect()
    assert found == pii.sanitise(frame, most_terms=1).orderBy("doc_id").collect()
    one = next(r for r in found if r["doc_id"] == 300)
    assert "Zimmer" in {one["text"][s["start"] : s["end"]] for s in one["pii"]["spans"] if s["kind"] == "term"} and "immer" not in one["pii"]["clean_text"]
    for r in (r for r in found if r["doc_id"] < 100):
        terms = [r["text"][s["start"] : s["end"]] for s in r["pii"]["spans"] if s["kind"] == "term"]
        assert terms == ["codenamex" if r["doc_id"] % 2 else "codenamey"] and "codename" not in r["pii"]["clean_text"]


def test_sharding(spark, data, given, odd, odd_rows, empty):
    for rows, frame, shards in ((given, spark.read.parquet(f"{data}/documents.parquet"), 40), (odd_rows, odd, 7)):
        placed = sharding.shard(frame, shards=shards).collect()
        same([(r["doc_id"], r["size"], r["text_crc32"]) for r in placed], [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows])
        slots: dict = {k: [] for k in range(shards)}
        for r in placed:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(empty).count() == 0


def test_a_further_shard_moves_few_rows(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=n).collect()} for n in (40, 41))
    moved = sum(before[i] != after[i] for i in before)
    assert 1 / 41 <= moved / len(before) < 0.055  # 2.4 % have to move


def test_a_shard_does_not_depend_on_partitions(spark, odd):
    docs = odd.unionByName(odd).select("doc_id", "text")
    placed = [sorted(map(tuple, sharding.shard(docs.repartition(n), shards=7).collect()), key=key) for n in (3, 11)]
    assert placed[0] == placed[1]


def test_language(spark, data, odd, odd_rows, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = Q["op2_language"](spark, data).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(odd, model).collect()
    same([(r["doc_id"], r["lang_pred"] == "und") for r in found], [(i, not any(map(str.isalpha, t or ""))) for i, t in odd_rows])
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_lm(spark, data, odd, odd_rows, empty):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    rows = [r for r in Q["op5_lm"](spark, data).collect() if r["doc_id"] in known and r["score"] is not None]
    good = [r["score"] for r in rows if known[r["doc_id"]] == (1, 0)]
    bad = [r["score"] for r in rows if known[r["doc_id"]] != (1, 0)]
    assert sum(a > b for a in good for b in bad) > 0.6 * len(good) * len(bad)
    marks = spark.createDataFrame([(6, 1, 0), (7, 1, None), (8, 1, 1), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    found = lm.score(odd, marks, block_bytes=50_000, bucket_entries=500).collect()
    same([(r["doc_id"], r["n_tokens"], r["score"] is None) for r in found], [(i, len(brute.words(t)), not brute.words(t)) for i, t in odd_rows])
    assert lm.score(empty, marks).count() == 0


def test_lm_by_hand(spark):
    """Every loss from plain counts."""
    import math
    from collections import Counter

    docs = {0: "a b a b c", 1: "a b d", 2: "e f e", 3: "a c"}
    good = {0, 1}
    frame, marks = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in lm.score(frame, marks, vocabulary=100, unigram_mass=5.0, bigram_mass=2.0).collect()}
    n_good = sum(len(t.split()) for i, t in docs.items() if i in good)
    n_rest = sum(len(t.split()) for i, t in docs.items() if i not in good)
    for i, text in docs.items():
        others = {j: t.split() for j, t in docs.items() if j != i}
        w = text.split()
        every = Counter(x for t in others.values() for x in t)
        losses = []
        for side, scale in ((True, 1.0), (False, n_good / n_rest)):
            texts = [t for j, t in others.items() if (j in good) == side]
            one, two = Counter(x for t in texts for x in t), Counter(p for t in texts for p in zip(t, t[1:], strict=False))
            total, loss = sum(one.values()) * scale, 0.0
            for k, x in enumerate(w):
                base = (every[x] + 1) / (sum(every.values()) + 100)
                p = (one[x] * scale + 5 * base) / (total + 5)
                q = (two[w[k - 1], x] * scale + 2 * p) / (one[w[k - 1]] * scale + 2) if k else p
                loss -= math.log(q)
            losses.append(loss / len(w))
        assert got[i]["loss_target"] == pytest.approx(losses[0]) and got[i]["loss_background"] == pytest.approx(losses[1])


def test_topk(spark, data):
    assert of_spark(Q["op6_topk"](spark, data)) == of_sql(queries.oracle_sql()["op6_topk"], data)
    rng = random.Random(2)
    vectors = {k: [rng.randrange(-3, 4) / 2 for _ in range(3)] for k in range(130)}
    rows = [(k, v) for k, v in vectors.items()] + [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]), (203, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dims", "2 AS q", "3 AS block", "4 AS part")
    got = topk.search(frame, "vec_id % 50 = 0 OR vec_id > 199", k=4, block_rows=17, query_rows=2).collect()
    want = []
    for a in (0, 50, 100):
        scored = sorted((-sum(int(256 * x) * int(256 * y) for x, y in zip(vectors[a], v, strict=True)), b) for b, v in vectors.items() if b != a)
        want += [(a, place, b, -s) for place, (s, b) in enumerate(scored[:4], 1)]
    same([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got], want)
    assert topk.search(frame.limit(0), "true").count() == 0
    twice = [(50, [1.0, 2.0]), (50, [2.0, 1.0]), (51, [1.0, 1.0]), *[(7, [1.0, 2.0])] * 9, (50, [1.0, 2.0])]
    got = topk.search(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), "vec_id = 50", k=3, scale=1).collect()
    want = []
    for a, (i, x) in enumerate(twice):
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j) for b, (j, y) in enumerate(twice) if b != a)
        want += [(i, place, j, -int(s)) for place, (s, j) in enumerate(scored[:3], 1)] if i == 50 else []
    same([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got], want)


def test_decontamination(spark, data, odd, empty):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in Q["op8_decontaminate"](spark, data).collect()}
    assert found >= {(d, i) for d, t in docs.items() for i, x in texts.items() if x in (t or "")}
    question = "A train leaves the old station at 9 o'clock with Anna and travels 120 km toward the harbour before 7 people get off"
    changed = "so A train leaves the old station at 10 o'clock with Maria and travels 300 miles toward the harbour before 4 people get off ok"
    broken = "A train leaves the old station at 9 o'clock with Anna and travels 9 km toward the harbour before 9 people get off"
    asked = spark.createDataFrame([(1, question), (2, None), (3, ""), (1, question)], "item_id long, text string")
    rows = spark.createDataFrame([(1, changed), (2, question), (3, broken), (4, "a train of thought leaves the old harbour at last"), (5, None), (None, question), (2, question)], "doc_id long, text string")
    got = {(r["doc_id"], r["verbatim"]) for r in decontaminate.contaminated(rows, asked).collect()}
    assert got == {(1, False), (2, True), (None, True)}
    assert decontaminate.contaminated(rows, asked, most_windows=1).count() == 3
    assert decontaminate.contaminated(odd, asked).count() == 0 == decontaminate.contaminated(empty, asked).count() == decontaminate.contaminated(rows, asked.limit(0)).count()


def test_decontamination_beside_values_that_collide(spark):
    rng = random.Random(8)
    plain = lambda n: " ".join(rng.choice(["river", "stone", "under", "walks", "green", "toward", "opens", "slow"]) for _ in range(n))
    item = f"{plain(20)} counts 12 apples and 15 pears {plain(20)}"
    often = " ".join(f"{plain(6)} 9 {plain(3)}" for _ in range(4)) + f" then 120 {plain(2)}"
    numbers = " ".join(map(str, rng.sample(range(1000), 20)))
    other = " ".join(str(rng.randrange(1000, 2000)) for _ in range(20))
    short = f"{plain(4)} 12 {plain(3)} 15 {plain(4)}"
    asked = spark.createDataFrame([(1, item), (2, numbers), (3, short), (4, often)], "item_id long, text string")
    rows = [(1, item.replace("15", "12")), (2, f"so {numbers} ok"), (3, other), (4, short.replace("15", "12")), (5, often.replace("120", "9")), (6, item), (7, item.replace("12", "30"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (2_000_000, 1):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame, asked, most_windows=most).collect()}
        assert {k: (r["start"], r["n_tokens"], r["n_slots"], r["verbatim"]) for k, r in got.items()} == {(1, 1): (0, 21, 0, True), (2, 2): (1, 20, 20, True), (5, 4): (0, 41, 1, True), (6, 1): (0, 46, 2, True), (7, 1): (0, 46, 2, False)}
