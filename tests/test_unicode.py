import random
import re
import unicodedata

from pyspark.sql import functions as F

from ringdata.functions import scalars as S
from ringdata.functions import unicode as U


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return [tuple(r)[1:] for r in sorted(df.select("i", U.nfkc(F.col("t")), U.casefold(F.col("t"))).collect())]


def test_every_character_and_random_texts(spark):
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and c]
    texts = ["\x01".join(points[i : i + 50]) for i in range(0, len(points), 50)]
    r = random.Random(3)
    marks = [c for c in points if unicodedata.combining(c)]
    odd = [c for c in points if unicodedata.decomposition(c)]
    jamo = [chr(c) for c in [*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3), 0xAC00, 0xAC01, 0xD788]]
    indic = list("োৗୈାෝ්ဦ")
    for _ in range(6000):
        pool = r.choice([marks, odd, jamo, indic, list("aeioucsAEIOéş̣̣̇̇́"), points])
        texts.append("".join(r.choice(pool if r.random() < 0.7 else list("aẹ́ 1")) for _ in range(r.randint(1, 8))))
    texts += ["", "ﬁ12", "é", "½", "straße", "ﷺ", "a" + "̣́" * 500, "é" * 5000]
    for text, got in zip(texts, run(spark, texts), strict=True):
        assert got == (unicodedata.normalize("NFKC", text), text.casefold()), text[:40].encode("unicode_escape")


def test_identifiers_as_python_folds_them(spark):
    texts = ["ﬁ12", "Café", "½ Main", "Straße 5", "ＡＢ​Ｃ", "ｶﾞ", "Å", "Ⅷ", "①②③", "ΣΑΣ", None, "​"]
    want = [" ".join(unicodedata.normalize("NFKC", t or "").replace("​", "").split()).casefold() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in sorted(df.select("i", S.normalize_identifier(F.col("t"))).collect())] == want
    phone = "①②③ ４５６７８９０"
    assert spark.createDataFrame([(phone,)], "t string").select(S.normalize_identifier(F.col("t"), phone=True)).first()[0] == "911234567890"


def test_blanks_and_classes():
    """Characters trimmed one by one are those of the class, and a class in spans holds what it was made of."""
    assert {chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "Z"} < set(S.BLANKS)
    assert all(re.fullmatch(r"\s", c) for c in S.BLANKS)
    assert U.any_of(["é", "ß", "ê"]) == r"[\x{DF}-\x{EA}&&[[\x{DF}-\x{EA}&&[\x{DF}-\x{DF}\x{E9}-\x{EA}]]]]"
