"""Byte-level BPE encoding and decoding by tree concatenation.

A text of more than TEXT_LEAF code points is halved, wherever the middle falls, down to
leaves; the leaves are encoded apart, and neighbours are concatenated up the tree. At a
join, a window of tokens on both sides is encoded again; it grows until it starts and
ends at places where the tokenizer's own pattern cuts whatever stands around them, and
its first and last tokens are those that both sides already had. What lies beyond such
places can't change, so this is exact. A run that the pattern never cuts is a tree of
its own: its window grows until both sides agree, since a BPE encoding is fixed by its
adjacent pairs.
Texts over `long_chars` code points become rows of leaves that any task can take;
shorter ones are encoded where they lie.
Defined cases: a null text counts as empty (no tokens); repeated rows are encoded
alike; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import texts

#: Fixed value: the pattern of the tokenizer's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places where PATTERN cuts whatever stands around them.
CUTS = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
LONG_CHARS = 16_384
#: Leaves of a text, and of a run that is never cut.
TEXT_LEAF, LEAF_CHARS = 2_048, 1_024
FIRST_WINDOW = 4


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """One vocabulary: whole texts, single runs of bytes, and ids back to bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        back = {ord(c): b for b, c in enumerate(letters)}
        ranks = {bytes(back[ord(c)] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.model = Tokenizer.from_file(path).model
        self.size = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.size[i] = len(token)
        self.joins = 0
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def run(self, data: bytes) -> list[int]:
        """Ids of bytes that form one pre-token."""
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, data)))] if data else []

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.plain.decode_bytes(ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Concatenate two encodings of one run: grow a window around the join until both sides agree."""
        w = FIRST_WINDOW
        while True:
            i, j = max(0, len(left) - w), min(len(right), w)
            middle = self.run(self.bytes_of([*left[i:], *right[:j]]))
            if (i == 0 or middle[0] == left[i]) and (j == len(right) or middle[-1] == right[j - 1]):
                return [*left[:i], *middle, *right[j:]]
            w *= 2

    def cut_before(self, ids: np.ndarray, w: int) -> int | None:
        """Where to cut the end of a side: the number of its first tokens that stay; None if its last w tokens don't show it."""
        i = max(0, len(ids) - w)
        cuts = self.cuts(ids[i:], i == 0)
        # the last cut but one, so that what both sides had shows again in the window
        return i + cuts[-2] if len(cuts) > 1 else 0 if i == 0 else None

    def cut_after(self, ids: np.ndarray, w: int) -> int | None:
        """Where to cut the start of a side: the number of its first tokens that are encoded again."""
        j = min(len(ids), w)
        cuts = self.cuts(ids[:j], True)
        return cuts[1] if len(cuts) > 1 else j if j == len(ids) else None

    def cuts(self, ids: np.ndarray, whole_start: bool) -> list[int]:
        """Tokens before each sure cut inside a stretch of ids."""
        data = self.bytes_of(ids.tolist())
        skip = 0
        if not whole_start:  # the first token may start inside a sign
            while skip < len(data) and data[skip] & 0xC0 == 0x80:
                skip += 1
        text = data[skip:].decode("utf-8", errors="ignore")  # so may the last one end
        ends = np.cumsum(self.size[ids])
        at, done, places = 0, skip, []
        for m in CUTS.finditer(text):
            done += len(text[at : m.start()].encode())
            at = m.start()
            k = int(np.searchsorted(ends, done))
            if 0 < done and k < len(ends) - 1 and ends[k] == done:
                places.append(k + 1)
        return places

    def join_texts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Concatenate the encodings of two neighbouring texts, cut anywhere between two signs."""
        self.joins += 1
        w = FIRST_WINDOW
        while True:
            i, j = self.cut_before(left, w), self.cut_after(right, w)
            if i is not None and j is not None:
                text = self.bytes_of([*left[i:].tolist(), *right[:j].tolist()]).decode()
                middle = self.plain.encode_to_numpy(text, allowed_special=set())
                if (i == 0 or middle[0] == left[i]) and (j == len(right) or middle[-1] == right[j - 1]):
                    return np.concatenate([left[:i], middle, right[j:]])
            w *= 2

    def halved(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens and without runs longer than a leaf."""
        if len(text) <= TEXT_LEAF:
            return self.plain.encode_to_numpy(text, allowed_special=set())
        mid = len(text) // 2
        return self.join_texts(self.halved(text[:mid]), self.halved(text[mid:]))

    def tree(self, leaves: list, join: Callable | None = None) -> list:
        """Concatenate neighbours pairwise, level by level."""
        join = join or self.join
        while len(leaves) > 1:
            leaves = [join(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def piece(self, text: str) -> np.ndarray:
        """Ids of a text of any length, on this machine."""
        if len(text) <= LEAF_CHARS:
            return self.plain.encode_to_numpy(text, allowed_special="all")
        words = text.split()
        lengths = list(map(len, words))
        # a run of white space longer than a leaf has that much beyond one sign for each gap
        plain = max(lengths, default=0) <= LEAF_CHARS and len(text) - sum(lengths) - len(words) <= LEAF_CHARS - 2
        out: list[np.ndarray] = []
        for special, part in split_special(text, self.special):
            if special:
                out.append(self.plain.encode_to_numpy(part, allowed_special="all"))
            elif plain:
                out.append(self.halved(part))
            else:
                for runs, stretch in stretches(part):
                    out += [np.array(self.whole(r), dtype=np.uint32) for r in runs] if runs else [self.halved(stretch)]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def whole(self, run: str) -> list[int]:
        return self.tree([self.run(leaf.encode()) for leaf in halves(run, LEAF_CHARS)])


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def split_special(text: str, special) -> Iterator[tuple[bool, str]]:
    at = 0
    for m in special.finditer(text) if special else ():
        if m.start() > at:
            yield False, text[at : m.start()]
        yield True, m[0]
        at = m.end()
    if at < len(text):
        yield False, text[at:]


def units(text: str) -> Iterator[tuple[str, list[str]]]:
    """Stretches between sure cuts; a long one also as the pre-tokens that PATTERN makes of it.

    A stretch is white space followed by signs of one class, or signs that end in an
    apostrophe followed by letters. The white space is cut as PATTERN does it.
    """
    at = 0
    for end in [m.start() for m in CUTS.finditer(text)] + [len(text)]:
        if end > at:
            unit = text[at:end]
            yield unit, pretokens(unit) if len(unit) > LEAF_CHARS else []
            at = end


def stretches(text: str) -> Iterator[tuple[list[str], str]]:
    """A text as units longer than a leaf, with their pre-tokens, and what lies between them."""
    pending: list[str] = []
    for unit, runs in units(text):
        if runs:
            if pending:
                yield [], "".join(pending)
                pending = []
            yield runs, unit
        else:
            pending.append(unit)
    if pending:
        yield [], "".join(pending)


def pretokens(unit: str) -> list[str]:
    """PATTERN's cuts in a stretch, by linear matching (no backtracking over long white space)."""
    out = []
    body = unit.lstrip() if not unit.isspace() else ""
    space = unit[: len(unit) - len(body)]
    if space and body:
        if space[-1] == " ":
            space, body = space[:-1], " " + body
            out += [space] if space else []
        else:
            out += [space[:-1]] if space[:-1] else []
            out.append(space[-1])
    elif space:
        out.append(space)
    if body:
        out += regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", body)
    return out


def halves(run: str, leaf: int) -> list[str]:
    if len(run) <= leaf:
        return [run]
    mid = len(run) // 2
    return [*halves(run[:mid], leaf), *halves(run[mid:], leaf)]


def cut_text(text: str, special, size: int) -> list[tuple[int, str]]:
    """(run, piece) rows of a long text: run 0 is free-standing; pieces of one text share a negative number, of one run that is never cut a positive one."""
    rows: list[tuple[int, str]] = []
    n = 0
    for is_special, part in split_special(text, special):
        if is_special:
            rows.append((0, part))
            continue
        for runs, stretch in stretches(part):
            for run in runs or [stretch]:
                n += 1
                rows += [(n if runs else -n, p) for p in halves(run, size)]
    return rows


def digests(ids: np.ndarray, model: ByteBpe) -> tuple[int, str, str]:
    text = model.bytes_of(ids.tolist()).decode("utf-8", errors="replace")
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, vocabulary: str, long_chars: int = LONG_CHARS, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian uint32) of every row."""
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    docs = texts(docs)

    def finish(key: str, keys: list, all_ids: list[np.ndarray]) -> pd.DataFrame:
        model = bpe(vocabulary)
        cols = list(zip(*[digests(i, model) for i in all_ids], strict=True)) or [[], [], []]
        frame = pd.DataFrame({key: keys, "n_tokens": cols[0], "ids_sha256": cols[1], "decoded_sha256": cols[2]})
        return frame.assign(ids=[i.astype("<u4").tobytes() for i in all_ids]) if keep_ids else frame

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = bpe(vocabulary)
        for f in frames:
            yield finish("doc_id", f["doc_id"], [model.piece(t) for t in f["text"]])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        special = bpe(vocabulary).special
        for f in frames:
            for key, text in zip(f["key"], f["text"], strict=True):
                rows = cut_text(text, special, long_chars)
                yield pd.DataFrame({"key": key, "part": range(len(rows)), "run": [r for r, _ in rows], "piece": [p for _, p in rows]})

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = bpe(vocabulary)
        for f in frames:
            ids = [np.array(model.whole(p), dtype=np.uint32) if run > 0 else model.halved(p) if run < 0 else model.piece(p) for run, p in zip(f["run"], f["piece"], strict=True)]
            yield f[["key", "part", "run"]].assign(ids=[i.tobytes() for i in ids])

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        model = bpe(vocabulary)
        f = f.sort_values("part")
        parts: list[np.ndarray] = []
        leaves: list = []
        last = 0
        for run, ids in zip([*f["run"], 0], [*f["ids"], b""], strict=True):
            if run != last and leaves:
                parts.append(np.array(model.tree(leaves, model.join_texts if last < 0 else None), dtype=np.uint32))
                leaves = []
            last = run
            ids = np.frombuffer(ids, dtype=np.uint32)
            if run:
                leaves.append(ids.tolist() if run > 0 else ids)
            else:
                parts.append(ids)
        return finish("key", f["key"].iloc[:1], [np.concatenate(parts)])

    is_long = F.length("text") > long_chars
    near = docs.where(~is_long).mapInPandas(short, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {out}")
    far = docs.where(is_long).withColumn("key", F.sha2("text", 256))
    rows = far.groupBy("key").agg(F.first("text").alias("text")).mapInPandas(cut, "key string, part long, run long, piece string")
    rows = rows.repartition("key", "part").mapInPandas(pieces, "key string, part long, run long, ids binary")
    whole = rows.groupBy("key").applyInPandas(gather, f"key string, {out}")
    return near.unionByName(far.drop("text").join(whole, "key").drop("key"))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text that the ids stand for."""

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = bpe(vocabulary)
        for f in frames:
            yield f[["doc_id"]].assign(text=[model.bytes_of(np.frombuffer(i, dtype="<u4").tolist()).decode("utf-8", errors="replace") for i in f["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(back, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary(), keep_ids=False)
