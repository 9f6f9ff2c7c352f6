"""Language-model scoring: a hierarchical Pitman-Yor model of words.

A token's restaurant is that of its context, the word before it (or the start of the
text); all context restaurants share one parent, the unigram restaurant, whose base is
uniform over the V training words and one unknown word. Seating is sampled by Gibbs
sweeps over the whole corpus: in each, the number of tables of every word in every
context is drawn from its full conditional (see seating.py) given the last sweep's
tables of its context and the parent's probability, both summed over all of the
corpus. Pairs that occur once have one table in every seating and are not drawn again.
Seatings are averaged over sweeps after BURN, and a token's probability takes the mean
number of its pair's tables given those averages.

How it runs: documents are dealt into buckets of about BUCKET_BYTES by hash. A bucket
sends its distinct (context, word) pairs, with training counts, to the pair shard of
the context (past SPREAD shards, of the context and a part of the word, so that a very
frequent context is spread); shards sum them, answer every bucket, and send sums by
word to word shards. A sweep is one exchange: word shards seat the parent and tell the
pair shards what they need of their words; these draw tables and send back the sums.
Only six sums in all pass through the driver. Draws depend on the words and the sweep
alone, so the scores do not depend on how many buckets and shards there are. Words are
known by their 64-bit XXH64.
Defined cases: a null text is empty and has one token, the end; a null doc_id counts
as the empty text for the split; repeated rows each count and score; without training
documents every token is the unknown word; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .seating import mean_tables, sample_tables
from .shared import remainder, stored, texts

#: Size of a bucket of texts; a small corpus still gets LEAST_BUCKETS, so that its work spreads over many tasks.
BUCKET_BYTES, LEAST_BUCKETS = 12 << 20, 48
BUCKETS_EACH_SHARD, LEAST_SHARDS, SPREAD = 3, 16, 32
START = b""  # no word is empty
END = b"\n"  # no word holds a line break
THETA, THETA_ROOT = 5.0, 20.0
BURN, SWEEPS = 1, 3
MESSAGE = "kind string, dst int, src int, data binary, sums array<long>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes. Those of 4 bytes an item are compressed; those of 8, sorted hashes, are kept as differences, whose three highest bytes compress well."""
    parts = []
    for a in arrays:
        raw = a.tobytes()
        if a.dtype.itemsize == 4:
            raw = zlib.compress(raw, 1)
        elif a.dtype.itemsize == 8:
            bytes_of = np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, 8).T
            raw = bytes_of[:5].tobytes() + zlib.compress(bytes_of[5:].tobytes(), 1)
        parts += [struct.pack("<cII", a.dtype.char.encode(), len(a), len(raw)), raw]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        char, items, n = struct.unpack_from("<cII", data, at)
        raw = data[at + 9 : at + 9 + n]
        kind = np.dtype(char.decode())
        if kind.itemsize == 4:
            raw = zlib.decompress(raw)
        elif kind.itemsize == 8:
            planes = np.frombuffer(raw[: 5 * items] + zlib.decompress(raw[5 * items :]), dtype=np.uint8).reshape(8, items)
            raw = np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind).tobytes()
        out.append(np.frombuffer(raw, dtype=kind))
        at += 9 + n
    return out


def messages(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "dst", "src", "data", "sums"])


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups begins in sorted keys, and the end."""
    return np.searchsorted(keys, np.arange(n + 1))


def joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, dtype=kind)])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the place of each key among them, as np.unique gives them, in half its memory."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    new = np.diff(keys, prepend=keys[:1] - 1) != 0
    at = np.empty(len(keys), dtype=np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], at


class Bucket:
    """The tokens of a bucket: words in the order of their shards, pairs likewise, and the pair of each token."""

    def __init__(self, rows: pd.DataFrame, shards: int):
        from xxhash import xxh64_intdigest

        seen: dict[bytes, int] = {START: 0}
        ids, lengths = [], []
        for text in rows["text"]:
            words = text.encode().lower().split()
            words.append(END)
            ids.append(np.fromiter([seen.setdefault(w, len(seen)) for w in words], dtype=np.int32, count=len(words)))
            lengths.append(len(words))
        ids = np.concatenate(ids)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        hashes = np.fromiter(map(xxh64_intdigest, seen), dtype=np.uint64, count=len(seen))
        n, end = len(seen), seen.get(END)
        del seen, words  # many small objects, gone before the large arrays come
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((hashes, shard))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        self.words, self.word_cuts = hashes[order], cuts(shard[order], shards)
        self.start, self.end = int(rank[0]), int(rank[end]) if end is not None else 0
        ids = rank[ids]
        keys = np.empty(len(ids), dtype=np.int64)
        keys[1:] = ids[:-1]
        keys[self.starts[:-1]] = self.start
        keys *= n
        keys += ids
        del ids
        keys, at = distinct(keys)
        u, w = (keys // n).astype(np.int32), (keys % n).astype(np.int32)
        del keys
        shard = pair_shard(self.words[u], self.words[w], shards)
        order = np.argsort(shard, kind="stable").astype(np.int32)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.u, self.w, self.at, self.pair_cuts = u[order], w[order], place[at], cuts(shard[order], shards)
        train = np.repeat(rows["train"].to_numpy(dtype=bool), lengths)
        self.count = np.bincount(self.at[train], minlength=len(order)).astype(np.uint32)

    def asks(self, bucket: int, shards: int) -> list[tuple]:
        rows = []
        for s in np.flatnonzero(np.diff(self.pair_cuts)).tolist():
            part = slice(self.pair_cuts[s], self.pair_cuts[s + 1])
            u, w = self.u[part], self.w[part]
            first = np.flatnonzero(np.diff(u, prepend=-1))
            runs = np.diff(np.append(first, len(u))).astype(np.uint32)
            local, at = np.unique(np.concatenate([u[first], w]), return_inverse=True)
            order = np.argsort(self.words[local])
            rank = np.empty(len(local), dtype=np.uint16 if len(local) < 1 << 16 else np.uint32)
            rank[order] = np.arange(len(local))
            rows.append(("asks", s, bucket, pack(self.words[local[order]], rank[at[: len(first)]], runs, rank[at[len(first) :]], self.count[part]), None))
        for s in np.flatnonzero(np.diff(self.word_cuts)).tolist():
            rows.append(("asks", shards + s, bucket, pack(self.words[self.word_cuts[s] : self.word_cuts[s + 1]]), None))
        return rows


def pair_shard(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair: that of its context, moved by a part of the word that grows with the number of shards."""
    ways = np.uint64(-(-shards // SPREAD))
    place = w // np.uint64(shards)
    place %= ways
    place *= np.uint64(0x9E3779B1)
    place += u // np.uint64(shards)
    place %= np.uint64(shards)
    return place.astype(np.int32)


def count_pairs(f: pd.DataFrame, shards: int) -> list[tuple]:
    """Sum one shard's pairs: counts to the buckets, sums to the words' shards, and the pairs that occur more than once."""
    f = f.sort_values("src")
    shard = int(f["dst"].iloc[0])
    if shard >= shards:  # words that buckets ask for wait until the seating is done
        return [("asks", shard - shards, int(b), d, None) for b, d in zip(f["src"], f["data"], strict=True)]
    seen = np.unique(np.concatenate([unpack(d)[0] for d in f["data"]]))
    keys, times = [], []
    for d in f["data"]:
        own, first, runs, second, count = unpack(d)
        own = np.searchsorted(seen, own)
        keys.append(np.repeat(own[first], runs) * len(seen) + own[second])
        times.append(count)
    pairs = np.concatenate(keys)
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    total = np.zeros(len(pairs), dtype=np.int64)
    for k, count in enumerate(times):
        keys[k] = np.searchsorted(pairs, keys[k]).astype(np.int32)
        np.add.at(total, keys[k], count)
    rows = [("counts", b, shard, pack(total[at].astype(np.uint32)), None) for b, at in zip(f["src"].tolist(), keys, strict=True)]
    del keys, times
    pairs, total = pairs[total > 0], total[total > 0]
    u, w = (pairs // len(seen)).astype(np.int32), (pairs % len(seen)).astype(np.int32)
    del pairs
    used = np.zeros(len(seen), dtype=bool)
    used[u] = used[w] = True
    words = seen[used]
    place = (words % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((words, place))
    rank = np.zeros(len(seen), dtype=np.int32)
    rank[np.flatnonzero(used)[order]] = np.arange(len(words), dtype=np.int32)
    u, w = rank[u], rank[w]
    words, edges = words[order], cuts(place[order], shards)
    sums = [np.bincount(u, minlength=len(words)), np.bincount(w, minlength=len(words)), np.bincount(w, total, len(words))]
    again = total > 1
    needed = np.zeros(len(words), dtype=bool)
    needed[u[again]] = needed[w[again]] = True
    for s in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[s], edges[s + 1])
        rows.append(("words", s, shard, pack(words[part], *[x[part].astype(np.uint32) for x in sums], needed[part]), None))
    rank = np.cumsum(needed) - 1
    rows.append(("pairs", shard, -1, pack(words[needed], *[x.astype(np.uint32) for x in (rank[u[again]], rank[w[again]], total[again])]), None))
    rows.append(("sums", shard, shard, b"", [int((total == 1).sum()), int((total == 2).sum())]))
    return rows


class Words:
    """A word shard: sums over its pair shards' messages of followers, contexts and occurrences of each word."""

    def __init__(self, f: pd.DataFrame):
        f = f[f["kind"] == "words"].sort_values("src")
        self.src = f["src"].tolist()
        got = [unpack(d) for d in f["data"]]
        self.words, at = np.unique(joined([g[0] for g in got], "u8"), return_inverse=True)
        self.followers, self.contexts, self.times = (np.bincount(at, joined([g[k] for g in got], "u4"), len(self.words)).astype(np.int64) for k in (1, 2, 3))
        ends = np.cumsum([0, *[len(g[0]) for g in got]])
        #: for each pair shard, the words of the pairs that it seats
        self.needed = [at[lo:hi][g[4]] for lo, hi, g in zip(ends[:-1], ends[1:], got, strict=True)]

    def further(self, f: pd.DataFrame, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables beyond the first of each pair, by context and by word, in one sweep."""
        of = dict(zip(self.src, self.needed, strict=True))
        by_context, by_word = np.zeros(len(self.words), dtype=np.int64), np.zeros(len(self.words), dtype=np.int64)
        for src, data in f.loc[f["kind"] == f"tables{sweep}", ["src", "data"]].itertuples(index=False):
            one, two = unpack(data)
            by_context[of[src]] += one
            by_word[of[src]] += two
        return by_context, by_word

    def seat(self, f: pd.DataFrame, sweep: int, d: float, new: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Tables of each context and the parent's discounted customers of each word, with the sums of customers and tables. new: weight of a new table in the parent."""
        by_context, by_word = self.further(f, sweep - 1) if sweep else (0, 0)
        customers = self.contexts + by_word
        tables = sample_tables(customers, np.full(len(customers), new), d, self.words, 1_000 + sweep)
        return self.followers + by_context, customers - d * tables, [int(customers.sum()), int(tables.sum())]


def discount(one: int, two: int) -> float:
    """n1 / (n1 + 2 n2), within reason; four digits, as tables of numbers are kept for each."""
    return round(min(max(one / max(one + 2 * two, 1), 0.1), 0.95), 4)


def score(docs: DataFrame, train: str = "train", bucket_bytes: int = BUCKET_BYTES, least: tuple[int, int] = (LEAST_BUCKETS, LEAST_SHARDS)) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row.

    docs: doc_id, text (null: empty) and a boolean column that says which rows train.
    """
    docs = texts(docs, F.col(train).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(least[0], math.ceil(size / bucket_bytes))
    shards = max(least[1], math.ceil(buckets / BUCKETS_EACH_SHARD))
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def ask(f: pd.DataFrame) -> pd.DataFrame:
        return messages(Bucket(f, shards).asks(int(f["bucket"].iloc[0]), shards))

    by = lambda df, n, key="dst": df.repartitionById(n, F.col(key)).groupBy(key)  # noqa: E731  (each group is a task)
    asked = by(dealt, buckets, "bucket").applyInPandas(ask, MESSAGE)
    counted = stored(by(asked, 2 * shards).applyInPandas(lambda f: messages(count_pairs(f, shards)), MESSAGE), "pitman-yor", "kind")
    kind = lambda name: counted.where(F.col("kind") == name)
    sums = lambda df, n: [x or 0 for x in df.where("kind = 'sums'").agg(*[F.sum(F.col("sums")[i]) for i in range(n)]).first()]
    d1 = discount(*sums(counted, 2))

    def measure(f: pd.DataFrame) -> pd.DataFrame:
        w = Words(f)
        known = w.contexts > 0
        return messages([("sums", -1, -1, b"", [int(known.sum()), int(w.times.sum()), int((w.contexts == 1).sum()), int((w.contexts == 2).sum())])])

    n_words, n_tokens, one, two = sums(by(kind("words"), shards).applyInPandas(measure, MESSAGE), 4)
    d0, base = discount(one, two), 1.0 / (n_words + 1)
    told, seated = kind("words"), []  # seated: sums of the parent's customers and tables, sweep by sweep
    for sweep in range(BURN + SWEEPS):
        new = (THETA_ROOT + d0 * (seated[-1][1] if seated else n_words)) * base

        def tell(f: pd.DataFrame) -> pd.DataFrame:  # run before the loop goes on
            w, dst = Words(f), int(f["dst"].iloc[0])
            tables, own, both = w.seat(f, sweep, d0, new)  # noqa: B023
            rows = [("parent", s, dst, pack(tables[at].astype(np.uint32), own[at].astype(np.float32)), None) for s, at in zip(w.src, w.needed, strict=True)]
            return messages([*rows, ("sums", -1, dst, b"", both)])

        replies = stored(by(told, shards).applyInPandas(tell, MESSAGE), "pitman-yor-parent", "kind")
        seated.append((*sums(replies, 2), new))
        customers, lower = seated[-1][0], (THETA_ROOT + d0 * seated[-1][1]) * base

        def draw(f: pd.DataFrame) -> pd.DataFrame:
            own = f[f["kind"] == "pairs"]
            if own.empty:
                return messages([])
            words, u, w, c = unpack(own["data"].iloc[0])
            got = [unpack(d) for d in f[f["kind"] == "parent"].sort_values("src")["data"]]
            of_context, parent = joined([g[0] for g in got], "u4"), joined([g[1] for g in got], "f4").astype(np.float64)
            u, w, c = u.astype(np.int64), w.astype(np.int64), c.astype(np.int64)
            x = (THETA + d1 * of_context[u]) * (parent[w] + lower) / (THETA_ROOT + customers)
            t = sample_tables(c, x, d1, words[u] * np.uint64(0x9E3779B97F4A7C15) + words[w], sweep) - 1
            one, two = (np.bincount(k, t, len(words)).astype(np.uint32) for k in (u, w))
            edges, src = cuts((words % np.uint64(shards)).astype(np.int64), shards), int(own["dst"].iloc[0])
            return messages([(f"tables{sweep}", s, src, pack(one[edges[s] : edges[s + 1]], two[edges[s] : edges[s + 1]]), None) for s in np.flatnonzero(np.diff(edges)).tolist()])

        drawn = kind("pairs").unionByName(replies.where("kind = 'parent'"), allowMissingColumns=True)
        drawn = stored(by(drawn, shards).applyInPandas(draw, MESSAGE), "pitman-yor-tables")
        told = kind("words").unionByName(drawn) if sweep < BURN else told.unionByName(drawn)

    kept = range(BURN + 1, BURN + SWEEPS + 1)  # sweep k reads the tables drawn in sweep k - 1
    weights = [*[s[2] for s in seated[BURN + 1 :]], (THETA_ROOT + d0 * seated[-1][1]) * base]

    def conclude(f: pd.DataFrame) -> pd.DataFrame:
        w, dst = Words(f), int(f["dst"].iloc[0])
        tables, own, both = np.zeros(len(w.words)), np.zeros(len(w.words)), np.zeros(2)
        for sweep, new in zip(kept, weights, strict=True):
            for total, x in zip((tables, own, both), w.seat(f, sweep, d0, new), strict=True):
                total += np.array(x) / SWEEPS
        rows = [("sums", -1, dst, b"", np.rint(both * SWEEPS).astype(int).tolist())]
        for bucket, data in f.loc[f["kind"] == "asks", ["src", "data"]].itertuples(index=False):
            words = unpack(data)[0]
            at = np.minimum(np.searchsorted(w.words, words), max(len(w.words) - 1, 0))
            hit = w.words[at] == words if len(w.words) else np.zeros(len(words), dtype=bool)
            take = lambda x, dtype: (np.where(hit, x[at], 0) if len(x) else np.zeros(len(hit))).astype(dtype)  # noqa: B023, E731
            rows.append(("answers", bucket, dst, pack(take(w.times, np.uint32), take(tables, np.float32), take(own, np.float32)), None))
        return messages(rows)

    answers = stored(by(told.unionByName(kind("asks")), shards).applyInPandas(conclude, MESSAGE), "pitman-yor-words", "kind")
    customers, tables = (x / SWEEPS for x in sums(answers, 2))

    def give(f: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(f, shards)
        got = got.sort_values("src")
        read = lambda name: [unpack(d) for d in got.loc[got["kind"] == name, "data"]]
        counts, words = np.concatenate([g[0] for g in read("counts")]).astype(np.int64), read("answers")
        times, of_context, parent = (np.concatenate([g[k] for g in words]).astype(np.float64) for k in range(3))
        lower = (parent + (THETA_ROOT + d0 * tables) * base) / (THETA_ROOT + customers)
        x = (THETA + d1 * of_context[b.u]) * lower[b.w]
        seats = times.copy()  # every occurrence of a word is the context of one token
        seats[b.start] = times[b.end]
        prob = (counts - d1 * mean_tables(counts, x, d1) + x) / (THETA + seats[b.u])
        add = lambda v: np.add.reduceat(v[b.at], b.starts[:-1])
        known = times[b.w]
        return pd.DataFrame(
            {
                "doc_id": f["doc_id"], "train": f["train"], "n_tokens": np.diff(b.starts), "n_known": add((known > 0).astype(np.int64)), "train_tokens": n_tokens,
                "base_score": add(np.log10((known + 1) / (n_tokens + (n_words + 1)))), "score": add(np.log10(prob)),
            }
        )

    mine = kind("counts").unionByName(answers.where("kind = 'answers'")).select("dst", "kind", "src", "data")
    return by(dealt, buckets, "bucket").cogroup(by(mine, buckets)).applyInPandas(give, f"doc_id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = score(docs.select("doc_id", "text", (~held_out).alias("train")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
