import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ringdata.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "<|endoftext|>", "a<|endoftext|>b " * 3, "don't 'S 'll ’s it's'", "x" * 5000, "ab" * 4000 + "'s" + "c" * 3000, "!" * 3000 + "'s" + "z" * 2500, "漢字かな" * 1500,
       " " * 4000, " " * 3000 + "end", "a" + "\n" * 3000 + " b", "\t" * 2100 + "x", "1" * 4000 + "a" * 3000, "é" * 2500 + "😀" * 900, "'" * 2500 + "ve got", "x\u0085y   z" * 800,
       "word and other " * 3000, "hello" * 700 + " " + "world" * 700 + " " * 1500 + "'re"]


def random_texts(n):
    r = random.Random(7)
    pools = ["abcde", "the ing", "'s t", "!?'", "01 ", " \n\t", "漢é", "lmno"]
    for _ in range(n):
        yield "".join("".join(r.choices(r.choice(pools), k=r.choice([1, 3, 900, 1500]))) for _ in range(r.randint(1, 7)))


def test_tree_equals_the_library():
    hf, model = Tokenizer.from_file(PATH), bpe.ByteBpe(PATH)
    for t in [*ODD, *random_texts(60)]:
        want = hf.encode(t, add_special_tokens=False).ids
        assert model.piece(t).tolist() == want, (t[:40], len(t))
        assert model.bytes_of(want).decode() == t
        for size in (1100, 3000):
            rows = bpe.cut_text(t, model.special, size)
            assert "".join(p for _, p in rows) == t


def test_documents_go_through_joins():
    """Every text of the given documents that is longer than a leaf is put together from halves, and equals the library's."""
    import pyarrow.parquet as pq

    hf, model = Tokenizer.from_file(PATH), bpe.ByteBpe(PATH)
    long = joined = 0
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        before = model.joins
        assert model.piece(t or "").tolist() == hf.encode(t or "", add_special_tokens=False).ids
        long += len(t or "") > bpe.TEXT_LEAF
        joined += model.joins > before
    assert joined >= long > 200


JOINED = ["I don't know  what 漢字 it's  \n\n about 12 345.67 — “né” ... ok's", "a  b\n c'll d'" + "'s e 's", "    x", "é😀 é😀é", "'" * 3 + " 'll 'lla"]


def test_joins_at_every_place():
    hf, model = Tokenizer.from_file(PATH), bpe.ByteBpe(PATH)
    for t in JOINED:
        want = hf.encode(t, add_special_tokens=False).ids
        for k in range(len(t) + 1):
            got = model.join_texts(model.plain.encode_to_numpy(t[:k]), model.plain.encode_to_numpy(t[k:]))
            assert got.tolist() == want, (t, k)


def test_query(spark, tmp_path):
    hf = Tokenizer.from_file(PATH)
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(1, None, 1), (None, "x" * 40_000, 1), (7, "漢字かな" * 9000, 1), (7, "漢字かな" * 9000, 1), (8, "some words, " * 4000 + "y" * 50_000 + " end", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    df.write.parquet(str(tmp_path / "documents.parquet"))

    def want(t):
        ids = hf.encode(t or "", add_special_tokens=False).ids
        dec = hf.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest()

    got = bpe.op6_bpe(spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *want(t)) for i, t, _ in rows), key=key)
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert bpe.encode(df.limit(0), PATH).count() == 0
