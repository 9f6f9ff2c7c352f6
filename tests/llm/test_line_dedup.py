"""Line dedup against a plain version, on planted and odd rows."""

import hashlib
from collections import defaultdict

from ringdata.llm.line_dedup import drop_lines, op13_line_dedup

SPACE = " \t\n\v\f\r"
LONG = "This line is repeated in many documents"


def plain(rows, min_chars=20, min_docs=3):
    """[(doc_id, lines, dropped, text)] by dictionaries; None is below all ids."""

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = [
    (1, f"one\n{LONG}\ntwo\n\n{LONG.upper()}\n"),
    (2, f"\t{LONG}\v \nÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"),
    (3, f"{LONG}\nlast holder\n  {LONG}"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (7, "ééééééééééééééééééééé\nexactly twenty chars"),
    (8, "exactly twenty chars\nnineteen characters"),
    (9, "Exactly TWENTY chars\r\nnineteen characters"),
    (10, "nineteen characters\n exactly twenty chars"),
    (11, f"two documents only, twice\n{LONG}\ntwo documents only, twice"),
    (12, "two documents only, twice"),
    (None, f"{LONG}\nwithout an id, as two rows are"),
    (None, "without an id, as two rows are\nother"),
    (13, "without an id, as two rows are"),
    (14, "rows that repeat count once only\nx"),
    (14, "rows that repeat count once only\nx"),
    (14, "rows that repeat count once only\ny"),
    (15, "rows that repeat count once only"),
]


def run(spark, rows, **options):
    got = drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr)


def test_against_plain(spark):
    assert run(spark, ROWS) == plain(ROWS)
    assert run(spark, ROWS, min_chars=1, min_docs=2) == plain(ROWS, 1, 2)
    assert run(spark, ROWS + [(16, "without an id, as two rows are")]) == plain(ROWS + [(16, "without an id, as two rows are")])


def test_repeated_row_third_holder(spark):
    rows = ROWS + [(16, "rows that repeat count once only")]
    got = run(spark, rows)
    assert got == plain(rows)
    assert [x for x in got if x[0] == 14] == [(14, 2, 1, "x"), (14, 2, 1, "x"), (14, 2, 1, "y")]


def test_hot_line_and_long_text(spark):
    rows = [(i, f"a line that every document holds\nown line of document number {i}") for i in range(3_000)]
    rows.append((3_000, "\n".join(["a line that every document holds"] * 50_000 + [f"line number {k} of a very long text" for k in range(50_000)])))
    rows.append((3_001, "x" * 2_000_000))
    assert run(spark, rows) == plain(rows)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_lines(empty).collect() == []
    rows = [(i, f"{LONG}\n{i}", i, "a", "b", "c", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, _doc string, _lost string, _hash string, _at int")
    got = drop_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.n_lines, r["n_lines_"], r.n_dropped, r["_doc"], r["_lost"]) for r in got.collect()) == [(i, str(i) if i < 3 else f"{LONG}\n3", i, 2, int(i < 3), "a", "b") for i in range(4)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op13_line_dedup(spark, d).collect()), key=repr)
    assert got == sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain(docs)), key=repr)
    assert sum(r[2] for r in got) > 0
