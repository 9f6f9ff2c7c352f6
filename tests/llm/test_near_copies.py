import random

import corpus_pipeline as c
from ringdata.llm import near_copies, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def dedup(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], SCHEMA)
    return sorted((r.doc_id for r in c.near_dedup(spark, docs, "").collect()), key=lambda i: (i is None, i))


def edited(r, words, least):
    """A copy with scattered words replaced, as far as the likeness stays at least `least`."""
    now = list(words)
    for at in r.sample(range(len(words)), len(words)):
        new = [*now[:at], f"x{r.random()}", *now[at + 1 :]]
        if likeness(" ".join(words), " ".join(new)) < least:
            break
        now = new
    return now


def test_near_copies_go(spark):
    r = random.Random(3)
    rows, level = [], {}
    for i in range(150):
        words = [f"w{r.randrange(5_000)}" for _ in range(r.randrange(150, 400))]
        least = (0.80, 0.85, 0.90)[i % 3]
        rows += [(i, " ".join(words)), (1_000 + i, " ".join(edited(r, words, least)))]
        level[1_000 + i] = least
        assert least <= likeness(rows[-1][1], rows[-2][1]) < least + 0.05
    kept = dedup(spark, rows)
    assert [i for i in kept if i < 1_000] == list(range(150))
    for least in (0.80, 0.85, 0.90):
        mine = [i for i in level if level[i] == least]
        assert sum(i not in kept for i in mine) >= 0.98 * len(mine), least


def test_one_of_each_group_and_no_others(spark, monkeypatch):
    r = random.Random(4)
    rows, blocks = [], []
    for b in range(3):
        a = [f"w{r.randrange(5_000)}" for _ in range(300)]
        # a chain of small edits whose end is unlike its start, and copies of that end
        chain = [a]
        for _ in range(12):
            chain.append(edited(r, chain[-1], 0.93))
        block = [" ".join(chain[-1])] * 30 + [" ".join(edited(r, chain[-1], 0.9)) for _ in range(30)]
        blocks.append([1_000 * b + 100 + i for i in range(60)])
        rows += [(1_000 * b + i, " ".join(w)) for i, w in enumerate(chain)] + list(zip(blocks[-1], block))
        # alike by less than the limit: no near-copy
        rows += [(1_000 * b + 900 + i, " ".join(edited(r, a, 0.6))) for i in range(5)]
    rows += [(5_000, None), (5_001, ""), (None, " "), (None, rows[0][1]), (5_003, "one two"), (5_003, "one two"), (5_004, "One  two")]
    text = dict(rows[:-7])
    for part in (shared.GROUP_PART, 5):
        monkeypatch.setattr(shared, "GROUP_PART", part)
        kept = dedup(spark, rows)
        assert None not in kept and 5_000 in kept and 5_001 not in kept and kept.count(5_003) == 1 and 5_004 not in kept
        stay = [i for i in kept if i < 5_000]
        assert all(likeness(text[i], text[j]) < 0.8 for i in stay for j in stay if i < j)
        assert all(sum(i in stay for i in block) <= 1 for block in blocks)
        assert all(1_000 * b + 900 + i in stay for b in range(3) for i in range(5))
    assert dedup(spark, []) == []


def test_rows_unlike_their_leader_are_regrouped(spark, monkeypatch):
    """All rows in one bucket: round after round, then all pairs, until none is left."""
    monkeypatch.setattr(near_copies, "ROUNDS", 1)
    r = random.Random(5)
    bases = [[f"w{r.randrange(5_000)}" for _ in range(100)] for _ in range(6)]
    rows = [(i, " ".join(bases[i % 6] if i < 6 else edited(r, bases[i % 6], 0.9))) for i in range(48)]
    nodes = near_copies.add_sets(spark.createDataFrame(rows, "doc_id long, text string"), 5).selectExpr("node", "struct(doc_id) AS best", "node AS fp", "array(1L) AS buckets", "hashes")
    links = near_copies.near_links(nodes.drop("hashes"), lambda wanted: nodes.select("node", "hashes").join(wanted, "node")).collect()
    of = {x.node: x.best.doc_id for x in nodes.collect()}
    assert all(of[x.a] < of[x.b] and likeness(rows[of[x.a]][1], rows[of[x.b]][1]) >= 0.8 for x in links)
    assert sorted(set(of.values()) - {of[x.b] for x in links}) == list(range(6))


def test_links_behind_a_spanning_link_that_proves_wrong(spark):
    """Fingerprints 0, 1 and 3 are spanned from 0; only 1 and 3 are alike, and no bucket holds both. Two of fingerprint 9 that differ from its first are alike too."""
    import numpy as np

    from ringdata.llm import near_copies, simhash

    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 63, 60, dtype=np.uint64), np.arange(40, dtype=np.uint64) * np.uint64(5)]))
    want = {(int(a), int(b)) for i, a in enumerate(fp) for b in fp[i + 1 :] if int(a ^ b).bit_count() <= 3}
    assert set(zip(*(x.tolist() for x in simhash.spanning_links(fp, 3, every=True)), strict=True)) == want

    base = {k: np.arange(k * 1000, k * 1000 + 20, dtype=np.uint32) for k in range(4)}
    far = (1 << 62) - 1
    rows = [(1, 0, base[0]), (2, 1, base[1]), (3, 3, base[1][1:]), (4, far, base[2]), (5, far, base[3]), (6, far, base[3][1:])]
    nodes = spark.createDataFrame([(k, (False, k, k), f, []) for k, f, _ in rows], "node long, best struct<no_id: boolean, doc_id: long, key: long>, fp long, buckets array<long>")
    sets = spark.createDataFrame([(k, x.tobytes()) for k, _, x in rows], "node long, hashes binary")
    links = near_copies.near_links(nodes, lambda wanted: sets.join(wanted, "node"))
    assert {tuple(r) for r in links.collect()} == {(2, 3), (5, 6)}
