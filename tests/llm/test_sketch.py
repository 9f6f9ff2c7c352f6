import base64
import hashlib
import random
import struct

from ringdata.llm import sketch


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        s = lambda x: {p for p in x.split("\n") if p}
        j = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(j(s(t), s(e)), 9), round(j(s(t), s(nxt)), 9)))
    return sorted(out, key=str)


def read(text):
    """Size and cells of a fingerprint: slot -> [count, digests, check sums]."""
    size, data = text.split(":")
    raw = base64.b64decode(data)
    return int(size), {slot: [n, k, c] for slot, n, k, c in struct.iter_unpack(">IIQI", raw)}


def folded(print_, size):
    m, cells = print_
    out = {}
    for slot, (n, k, c) in cells.items():
        at = out.setdefault(slot // m * size + slot % m % size, [0, 0, 0])
        at[0], at[1], at[2] = at[0] + n, at[1] ^ k, at[2] ^ c
    return out


def likeness(a, b, n_own, check_of, places_of):
    """Subtract two fingerprints and peel; None where digests are left."""
    size = min(a[0], b[0])
    x, y = folded(a, size), folded(b, size)
    cells = {s: [x.get(s, [0, 0, 0])[0] - y.get(s, [0, 0, 0])[0], *(p ^ q for p, q in zip(x.get(s, [0, 0, 0])[1:], y.get(s, [0, 0, 0])[1:]))] for s in x.keys() | y.keys()}
    only = [0, 0]
    while True:
        pure = next((v for v in cells.values() if abs(v[0]) == 1 and check_of.get(v[1]) == v[2]), None)
        if pure is None:
            break
        n, k, c = pure
        only[n < 0] += 1
        for t, h in enumerate(places_of[k]):
            v = cells[t * size + h % size]
            v[0], v[1], v[2] = v[0] - n, v[1] ^ k, v[2] ^ c
    if any(any(v) for v in cells.values()):
        return None
    union = n_own + only[1]
    return 1.0 if not union else (n_own - only[0]) / union


def check(spark, rows, tmp):
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    got = sketch.op10_fingerprints(spark, str(tmp)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == brute(rows)
    by = {}
    text = dict(rows)
    for r in got:
        assert by.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert len(set(by.values())) >= len(by) - 1  # a null text and texts of blank lines share one


def test_the_returned_fingerprints_are_subtracted(spark):
    """Cells by brute force, and likenesses from the returned texts alone wherever these can be peeled."""
    r = random.Random(8)
    texts = ["\n".join(f"line {r.randint(0, 60)}" for _ in range(r.choice([1, 2, 5, 12, 40, 130]))) for _ in range(60)] + ["", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(sketch.fingerprint(df).collect())
    lines = {x for t in texts for x in t.split("\n")} | {e for k, t in enumerate(texts) for e in (t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2]).split("\n")}
    hashed = spark.createDataFrame([(x,) for x in lines], "x string").selectExpr("x", "xxhash64(x) AS k").selectExpr("x", "k", "xxhash64(k, 'check') & 4294967295 AS c", "array(xxhash64(k, 0), xxhash64(k, 1), xxhash64(k, 2)) AS p").collect()
    u = lambda k: k % 2**64
    check_of, places_of, key_of = {u(h.k): h.c for h in hashed}, {u(h.k): h.p for h in hashed}, {h.x: u(h.k) for h in hashed}
    peeled = 0
    for k, row in enumerate(got):
        keys = {key_of[x] for x in texts[k].split("\n") if x}
        size, cells = read(row.fingerprint)
        want = {}
        for key in keys:
            for t, h in enumerate(places_of[key]):
                v = want.setdefault(t * size + h % size, [0, 0, 0])
                v[0], v[1], v[2] = v[0] + 1, v[1] ^ key, v[2] ^ check_of[key]
        assert cells == want and size >= max(4, 0.8 * len(keys)) and size & (size - 1) == 0
        for other, near in ((row.edited_fingerprint, row.near_edited), (got[(k + 1) % len(got)].fingerprint, row.near_next)):
            found = likeness(read(row.fingerprint), read(other), len(keys), check_of, places_of)
            assert found is None or abs(found - near) < 1e-12
            peeled += found is not None
    assert peeled > 0.6 * 2 * len(got)


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_DOCS", 9)
    r = random.Random(3)
    line = lambda: "é" * r.randint(0, 3) + str(r.randint(0, 40))
    rows = [(i * (1 if i < 40 else 10**9), "\n".join(line() for _ in range(r.choice([1, 3, 10, 60])))) for i in range(70)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "one"), (1004, "one"), (5000, "\n".join(map(str, range(3000)))), (5001, "\n".join(map(str, range(1500, 4000)))), (5002, "word " * 200_000)]
    check(spark, rows, tmp_path / "a")
    check(spark, [(7, "a\nb")], tmp_path / "b")
    check(spark, [(None, "x\ny"), (1, "x\nz"), (1, "x\nz")], tmp_path / "c")
    assert sketch.fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0
