"""Ranked lexical search: an inverted index in segments, walked by Block-Max MaxScore.

Index: every task turns the documents it reads into segments (at most SEGMENT_DOCS
documents, about SEGMENT_POSTINGS postings), in order of doc_id, without a shuffle. A
segment has a row for each term: its postings, packed in blocks of BLOCK (variable-length
steps and counts), with the first and last document and the greatest value of each block.
Every term of every document is indexed; the table can be searched again and again.
Search: terms get their weights from document frequencies over all segments. In a
segment, lists are ordered by their bound (weight x greatest value). Lists whose bounds
together stay below the threshold (the score of the k-th best so far) are non-essential:
only documents in the other, essential lists are candidates. They are scored window by
window; to a candidate's score the block maxima of the non-essential lists are added, and
those below the threshold go before any of these blocks is unpacked; what is left is
scored list by list, with the bound drawn closer each time. The best of some segments
give every other one a threshold to start from; each segment sends at most k rows an
item, which are merged first by groups of segments, then whole.
Scores are whole numbers as the contract has them, and the pruning loses none: a document
goes only if its bound is below the score of k others.
Memory: a task holds one segment and one block of items (at most ITEM_TERMS terms, or one
item); blocks of items are searched one after another.
Defined cases: a null text has no terms and is never found, nor is a document of weight-0
terms only; items without terms give no rows; rows that repeat are documents each; equal
scores go by ascending doc_id, rows without one last; rows of items that repeat whole
(id and text) count once; very long texts are read in slices; an empty table of documents
or items gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringdata.operators.edges import numbered

from .shared import remainder, stored, texts, unused

TOP = 50
#: Postings of a block; documents and postings of a segment; documents of a window; terms of items searched at once; signs of a text counted at once.
BLOCK, SEGMENT_DOCS, SEGMENT_POSTINGS, WINDOW, ITEM_TERMS, SLICE = 64, 1 << 16, 1 << 21, 2_048, 500_000, 1 << 22
#: One segment in SAMPLE is searched first, for the thresholds of the others; GROUPS: groups of segments merged apart.
SAMPLE, GROUPS = 16, 64

_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of UTF-8: letters and digits of ASCII and all that is not ASCII stay, A-Z lower-cased; the others are spaces.
TERM_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0x20 for b in range(256))


def count_terms(text: str | None) -> Counter:
    """Occurrences of each term (bytes of UTF-8)."""
    found: Counter = Counter()
    data, rest = text or "", b""
    for k in range(0, len(data), SLICE):
        part = rest + data[k : k + SLICE].encode("utf-8", "surrogatepass").translate(TERM_BYTES)
        if k + SLICE < len(data):  # a term may go on in the next slice
            cut = part.rfind(b" ") + 1
            part, rest = part[:cut], part[cut:]
        found.update(part.split())
    return found


def value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs tf times gives a document of length norm m, before its weight."""
    return 1_000_000_000 * tf // (1_000 * tf + 20 * m)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of seven bits each (the last has the high bit clear), and the number of bytes of each."""
    v = values.astype(np.uint64)
    width = np.ones(len(v), dtype=np.int64)
    for s in range(7, 63, 7):
        width += v >> np.uint64(s) > 0
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(v) else 0, dtype=np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        byte = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[has] - width[has] + k] = byte | np.where(width[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, width


def unpack(data: np.ndarray) -> np.ndarray:
    """The whole numbers that pack wrote."""
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    at = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * at), starts)


INDEX = "segment string, term string, df long, payload binary, offsets array<int>, first array<int>, last array<int>, top array<long>, ids array<long>, norms array<long>"


def segment_rows(name: str, ids: list[int | None], sizes: list[int], terms: list[bytes], term: np.ndarray, doc: np.ndarray, tf: np.ndarray, norm: tuple[int, int]) -> Iterator[dict]:
    """The rows of one segment: its documents (term null), and each term's list; doc numbers follow doc_id, null last."""
    n_docs, n_terms = norm
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    m = np.array([50 + 50 * sizes[i] * n_docs // n_terms for i in order], dtype=np.int64)
    none: dict = dict.fromkeys(c.split()[0] for c in INDEX.split(", "))
    yield none | {"segment": name, "ids": [ids[i] for i in order], "norms": m.tolist()}

    doc = place[doc]
    by = np.lexsort((doc, term))
    term, doc, tf = term[by], doc[by], tf[by]
    gain = value(tf, m[doc])
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    lengths = np.diff(np.append(starts, len(term)))
    # places within a list; blocks start at every BLOCK-th
    at = np.arange(len(term)) - np.repeat(starts, lengths)
    heads = np.flatnonzero(at % BLOCK == 0)
    step = np.diff(doc, prepend=0)
    step[heads] = 0  # a block's first document is in its header
    data, width = pack(np.column_stack([step, tf]).ravel())
    byte = np.concatenate([[0], np.cumsum(width)])
    head_byte = np.append(byte[2 * heads], byte[-1])
    first, last, top = doc[heads], doc[np.append(heads[1:], len(doc)) - 1], np.maximum.reduceat(gain, heads) if len(heads) else gain
    head_of = np.searchsorted(heads, np.append(starts, len(term)))
    for k in range(len(starts)):
        a, b = head_of[k], head_of[k + 1]
        edges = head_byte[a : b + 1]
        yield none | {"segment": name, "term": terms[term[starts[k]]].decode("utf-8", "surrogatepass"), "df": int(lengths[k]), "payload": data[edges[0] : edges[-1]].tobytes(), "offsets": (edges - edges[0]).tolist(), "first": first[a:b].tolist(), "last": last[a:b].tolist(), "top": top[a:b].tolist()}


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, their terms with repeats."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = total = 0
        for f in frames:
            for t in f["text"]:
                size = sum(count_terms(t).values()) if len(t) > SLICE else len(t.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split())
                n, total = n + (size > 0), total + size
        yield pd.DataFrame({"n": [n], "total": [total]})

    row = docs.select("text").mapInPandas(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, segment_docs: int = SEGMENT_DOCS, segment_postings: int = SEGMENT_POSTINGS) -> tuple[DataFrame, int]:
    """The index of docs (doc_id, text) as a table, and N."""
    rows = texts(docs)
    n_docs, n_terms = corpus_size(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held = _Held()
        for f in frames:
            for i, t in zip(f["doc_id"], f["text"], strict=True):
                held.add(None if i is None else int(i), count_terms(t))
                if len(held.ids) >= segment_docs or len(held.tf) >= segment_postings:
                    yield from held.frames(f"{part}-{made}", (n_docs, n_terms))
                    held, made = _Held(), made + 1
        yield from held.frames(f"{part}-{made}", (n_docs, n_terms))

    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, INDEX)
    return stored(found, "search-index"), n_docs


class _Held:
    """Documents of a segment as they come."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.term, self.tf, self.many = array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, found: Counter) -> None:
        if found:
            self.ids.append(doc_id)
            self.sizes.append(found.total())
            self.term.extend(map(self.number.__getitem__, found))
            self.tf.extend(found.values())
            self.many.append(len(found))

    def frames(self, name: str, norm: tuple[int, int]) -> Iterator[pd.DataFrame]:
        if not self.ids:
            return
        doc = np.repeat(np.arange(len(self.ids)), self.many)
        rows = segment_rows(name, self.ids, self.sizes, list(self.number), np.array(self.term), doc, np.array(self.tf), norm)
        batch: list[dict] = []
        for r in rows:
            batch.append(r)
            if len(batch) == 5_000 or r["term"] is None:
                yield pd.DataFrame(batch)
                batch = []
        if batch:
            yield pd.DataFrame(batch)


class Postings(NamedTuple):
    """A term's list in a segment."""

    payload: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    last: np.ndarray
    top: np.ndarray

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of some blocks, in order."""
        if not len(blocks):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if blocks[-1] - blocks[0] + 1 == len(blocks):
            data = self.payload[self.offsets[blocks[0]] : self.offsets[blocks[-1] + 1]]
        else:
            data = np.concatenate([self.payload[self.offsets[b] : self.offsets[b + 1]] for b in blocks])
        pairs = unpack(data).reshape(-1, 2)
        # all blocks but a list's last are full
        head = np.arange(0, len(pairs), BLOCK)
        run = np.cumsum(pairs[:, 0])
        width = np.minimum(BLOCK, len(pairs) - head)
        return run + np.repeat(self.first[blocks] - run[head], width), pairs[:, 1]


class Work(NamedTuple):
    """Counts of a walk: blocks there, blocks unpacked, candidates, and those rejected before unpacking."""

    blocks: int
    unpacked: int
    candidates: int
    rejected: int


def best_in_segment(lists: list[tuple[int, Postings]], m: np.ndarray, k: int, threshold: int = 1) -> tuple[np.ndarray, np.ndarray, Work]:
    """Documents and scores of the k best with at least the threshold, best first, of equal ones the first; lists: (weight, list)."""
    bound = np.array([w * int(p.top.max()) for w, p in lists], dtype=np.int64)
    order = np.argsort(bound, kind="stable")
    lists, bound = [lists[i] for i in order], bound[order]
    upto = np.cumsum(bound)
    docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    unpacked = candidates = rejected = 0
    for low in range(0, len(m), WINDOW):
        high = min(low + WINDOW, len(m))
        # lists 0 .. essential - 1 together stay below the threshold
        essential = int(np.searchsorted(upto, threshold))
        if essential == len(lists):
            break
        score, seen = np.zeros(high - low, dtype=np.int64), np.zeros(high - low, dtype=bool)
        for w, p in lists[essential:]:
            blocks = np.arange(np.searchsorted(p.last, low), np.searchsorted(p.first, high))
            d, tf = p.read(blocks)
            unpacked += len(blocks)
            a, b = np.searchsorted(d, (low, high))
            d, tf = d[a:b], tf[a:b]
            score[d - low] += w * value(tf, m[d])
            seen[d - low] = True
        here = np.flatnonzero(seen)
        candidates += len(here)
        score, here = score[here], here + low
        # block maxima of the non-essential lists: above[j] bounds what list j can add to each candidate
        above = np.zeros((essential, len(here)), dtype=np.int64)
        where = np.zeros((essential, len(here)), dtype=np.int64)
        for j, (w, p) in enumerate(lists[:essential]):
            at = np.minimum(np.searchsorted(p.last, here), len(p.last) - 1)
            where[j] = at
            above[j] = np.where((p.first[at] <= here) & (here <= p.last[at]), w * p.top[at], 0)
        most = score + above.sum(axis=0)
        go = most >= threshold
        rejected += int(len(here) - go.sum())
        for j in range(essential - 1, -1, -1):
            here, score, most, above, where = here[go], score[go], most[go], above[:, go], where[:, go]
            maybe = above[j] > 0
            if maybe.any():
                w, p = lists[j]
                blocks = np.unique(where[j][maybe])
                d, tf = p.read(blocks)
                unpacked += len(blocks)
                at = np.minimum(np.searchsorted(d, here), len(d) - 1)
                exact = np.where(d[at] == here, w * value(tf[at], m[here]), 0)
                score = score + exact
                most = most - above[j] + exact
            go = most >= threshold
        here, score = here[go], score[go]
        docs, scores = np.concatenate([docs, here]), np.concatenate([scores, score])
        keep = np.argsort(-scores, kind="stable")[:k]
        docs, scores = docs[keep], scores[keep]
        keep = scores >= threshold
        docs, scores = docs[keep], scores[keep]
        if len(scores) == k:
            threshold = max(threshold, int(scores[-1]))
    return docs, scores, Work(sum(len(p.first) for _, p in lists), unpacked, candidates, rejected)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


FOUND = "place long, doc_id long, score long"


def search_segments(index: DataFrame, items: dict[int, dict[str, int]], thresholds: dict[int, int], top: int) -> DataFrame:
    """place (of the item), doc_id and score of the best of each segment; items: place -> term -> weight, of checked size; index has their terms alone."""
    shared = index.sparkSession.sparkContext.broadcast((items, thresholds))

    def run(_: tuple, f: pd.DataFrame) -> pd.DataFrame:
        items, thresholds = shared.value
        own = f[f["term"].isna()].iloc[0]
        ids, m = own["ids"], np.asarray(own["norms"], dtype=np.int64)
        lists = {r.term: Postings(np.frombuffer(r.payload, dtype=np.uint8), np.asarray(r.offsets), np.asarray(r.first), np.asarray(r.last), np.asarray(r.top)) for r in f[f["term"].notna()].itertuples()}
        out: list[pd.DataFrame] = []
        for place, terms in items.items():
            mine = [(w, lists[t]) for t, w in terms.items() if w > 0 and t in lists]
            if mine:
                docs, scores, _ = best_in_segment(mine, m, top, max(1, thresholds.get(place, 1)))
                out.append(pd.DataFrame({"place": place, "doc_id": pd.array([None if pd.isna(ids[d]) else int(ids[d]) for d in docs], dtype="Int64"), "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"place": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})

    return index.groupBy("segment").applyInPandas(run, FOUND)


def merged(found: DataFrame, top: int) -> DataFrame:
    """rank (from 1) of the best rows of each place: first within groups of rows, then whole."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = found.withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("place", "_group").orderBy(*order))).where(F.col("rank") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= top).drop("_group")


def item_blocks(counts: list[tuple[int, int]], terms: int) -> list[list[int]]:
    """Places dealt to blocks of at most so many terms, or one item."""
    blocks: list[list[int]] = []
    room = 0
    for place, n in counts:
        if not blocks or n > room:
            blocks.append([])
            room = terms
        blocks[-1].append(place)
        room -= n
    return blocks


def search(index: DataFrame, n_docs: int, items: DataFrame, top: int = TOP, key: str = "item_id", item_terms: int = ITEM_TERMS) -> DataFrame:
    """item key, rank, doc_id, score of the top documents of each item (key, text)."""
    spark = index.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, t in zip(f["place"], f["text"], strict=True):
                terms = [x.decode("utf-8", "surrogatepass") for x in count_terms(t)]
                for k in range(0, len(terms), 10_000):
                    yield pd.DataFrame({"place": p, "term": terms[k : k + 10_000]})

    place, text = unused([key], "place", "text")
    asking = items.select(key, F.coalesce("text", F.lit("")).alias(text)).distinct()
    asking = stored(numbered(asking, [F.asc_nulls_last(key), text], place), "search-items")
    wanted = stored(asking.select(F.col(place).alias("place"), F.col(text).alias("text")).mapInPandas(run, "place long, term string"), "search-terms")
    df = index.where("term IS NOT NULL").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = stored(wanted.join(df, "term"), "search-weights")
    counts = [(r["place"], r["count"]) for r in weighed.groupBy("place").count().orderBy("place").collect()]
    results = []
    for block in item_blocks(counts, item_terms):
        mine = weighed.where(F.col("place").between(block[0], block[-1]))
        asked: dict[int, dict[str, int]] = {}
        for r in mine.collect():  # at most ITEM_TERMS rows, or one item's
            asked.setdefault(r["place"], {})[r["term"]] = weight(n_docs, r["df"])
        # every segment's documents and its lists of the block's terms
        part = index.where("term IS NULL").unionByName(index.where("term IS NOT NULL").join(F.broadcast(mine.select("term").distinct()), "term", "left_semi").select(index.columns))
        sampled = remainder(F.col("segment"), SAMPLE) == 0
        sample = merged(search_segments(part.where(sampled), asked, {}, top), top)
        sample = stored(sample, "search-sample")
        known = {r["place"]: r["score"] for r in sample.where(F.col("rank") == top).collect()}  # one row an item
        results.append(sample.drop("rank").unionByName(search_segments(part.where(~sampled), asked, known, top)))
    if not results:
        return spark.createDataFrame([], f"`{key}` {items.schema[key].dataType.simpleString()}, rank int, doc_id long, score long")
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    best = merged(found, top)
    return best.join(asking.select(F.col(place).alias("_place"), F.col(key).alias("_key")), F.col("place") == F.col("_place")).select(F.col("_key").alias(key), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, n_docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), corpus AS (
    SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM sizes
), norms AS (
    SELECT doc_id, 100 - 50 + (50 * n * nn) // l AS m FROM sizes, corpus
), weights AS (
    SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term, nn
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
