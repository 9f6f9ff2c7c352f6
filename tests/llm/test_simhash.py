import random

import numpy as np
import xxhash

from ringdata.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def flips(r, fp, k):
    for b in r.sample(range(64), k):
        fp ^= 1 << b
    return fp


def test_index_equals_brute_force():
    r = random.Random(5)
    for size in (2, 9, 300):
        centres = [r.getrandbits(64) for _ in range(4)]
        fps = list({flips(r, r.choice(centres), r.choice([0, 1, 2, 4, 6, 9])) for _ in range(size)})
        a, b = simhash.spanning_links(np.array(fps, dtype=np.uint64), 4)
        assert all((int(x) ^ int(y)).bit_count() >= 1 for x, y in zip(a, b))
        at = {f: i for i, f in enumerate(fps)}
        want = brute_groups(fps)
        got = list(range(len(fps)))
        for x, y in zip(a.tolist(), b.tolist()):
            i, j = sorted((at[x], at[y]))
            old, new = max(got[i], got[j]), min(got[i], got[j])
            got = [new if g == old else g for g in got]
        assert [want.index(w) for w in want] == [got.index(g) for g in got]


def test_groups(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [r.choices(words, k=k) for k in (300, 500, 80, 6, 3)]
    rows = []
    for i in range(160):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i * 3, r.choice([" ", "\n"]).join(t).upper(), "c"))
    rows += [(1, None, "x"), (2, "", "x"), (4, " \t", "x"), (5, "One", "x"), (5, "One", "x"), (7, "é Ünï", "x"), (None, "One", "x"), (8, "a b c d " * 4000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    fps = [brute_fp(t) for _, t, _ in rows]
    group = brute_groups(fps)
    ids = {}
    for (i, _, _), g in zip(rows, group):
        ids[g] = i if ids.get(g) is None else min(ids[g], i if i is not None else ids[g])
    want = sorted(((i, f"{f:016x}", ids[g]) for (i, _, _), f, g in zip(rows, fps, group)), key=str)
    for hot in (4_000, 12):
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
        got = sorted((tuple(x) for x in simhash.op3_simhash(spark, str(tmp_path)).collect()), key=str)
        assert got == want
    assert simhash.group(df.limit(0)).count() == 0


def test_links_of_many_fingerprints(spark, monkeypatch):
    """Every number of bands, hot buckets dealt again and blocks: the same components as brute force."""
    r = random.Random(11)
    centres = [r.getrandbits(64) for _ in range(150)]
    # a hot bucket: many that agree on their low 40 bits
    fps = list({flips(r, r.choice(centres), r.randrange(8)) for _ in range(700)} | {(r.getrandbits(24) << 40) | 12_345 for _ in range(300)})
    want = brute_groups(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for bucket, hot in ((512, 4_000), (1, 4_000), (512, 40), (1e-9, 30)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
        at, root = {f: i for i, f in enumerate(fps)}, list(range(len(fps)))
        for x in simhash.near_links(df).collect():
            i, j = sorted(at[int(np.int64(v).view(np.uint64))] for v in (x.a, x.b))
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if g == old else g for g in root]
        assert [want.index(w) for w in want] == [root.index(g) for g in root]
    monkeypatch.undo()
    assert simhash.bands_for(10**3, 4) == 5 and simhash.bands_for(10**8, 4) == 6 and simhash.bands_for(10**12, 4) == 8
