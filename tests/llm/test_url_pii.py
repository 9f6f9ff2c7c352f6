import hashlib
import re
import time

from pyspark.sql import functions as F

from ringdata.llm import pii, shared, url_filter

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [
    None, "", "x" * 50_000, "1" * 30_000, "1-" * 9_000, "a.b" * 9_000 + "@x.y",
    "é😀 mail a@b.com_x@y.com, 1.2.3.4.5.6.7.8 and 300.1.1.1 11.2.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, +1 (425) 555-0100 +12 +1234567",
    "@a.b a@b a@-.-. 4485275742308327", "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00",
    'token = "473a0b8c09b8e90e7e8c9575180f595f646cf296" ssn 123-45-6789 but 123-45-6780',
]


def test_pii_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (None, "a@b.cd", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, pii string").write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op1_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert pii.op1_pii(spark, str(tmp_path)).where("doc_id < 0").count() == 0
    for r in got:
        text = "a@b.cd" if r.doc_id is None else TEXTS[r.doc_id] or ""
        want = brute(text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r, want)
        assert r.spans.startswith(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in PATTERNS]
    by = {r.doc_id: r.spans for r in got}
    assert by[9].count("iban") == 1 and by[10].count("secret") == 1 and by[10].count("ssn") == 2


def test_many_matches(spark):
    """Positions and masks of very many matches, in time that grows with their number."""
    text = "é " + " ".join(f"u{i}@example.org 10.0.{i % 256}.7" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii.find_pii(df).first()
    assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.pii) == brute(text)
    assert pii.mask_pii(pii.find_pii(df)).first().text == "é " + " ".join(["[EMAIL] [IP]"] * 20_000)
    assert time.time() - began < 40
    assert pii.mask_pii(pii.find_pii(df.limit(0))).count() == 0


def test_secrets(spark):
    # put together here, so that no line of this file looks like a key
    yes = ["key AKIA" + "ABCDEFGHIJ234567", "use ghp_" + "a1B2" * 9, "password: Zm9vYmFyMTIzNDU2Nzg5cXdlcnR5", "sk_live_" + "4eC39HqLyjWDarjtT1zdp7dc"]
    no = ["Zm9vYmFyMTIzNDU2Nzg5cXdlcnR5", "secret internationalisierungswoerter", "token 00000000000000000000000000000000", "AKIA"]
    df = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.pii] for r in pii.find_pii(df).collect()}
    assert all(any(k in ("key", "secret") for k in got[i]) for i in range(len(yes)))
    assert not any(k in ("key", "secret") for i in range(len(yes), len(got)) for k in got[i])


def test_list_entries_and_hot_urls(spark, monkeypatch):
    monkeypatch.setattr(shared, "GROUP_PART", 5)
    urls = ["http://a.listed.org/x/y"] * 50 + ["http://listed.org/z", "http://listed.org/x", "http://listed.com/x", None] + [""] * 30
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("Listed.org", "/x", "block"), ("a.listed.org", None, "allow"), ("listed.org", "/x/y", "block"), ("listed.com", "/x", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, listed=listed)).collect()}
    # the longest entry wins; a rule wins over every entry
    assert len(got) == len(urls)
    assert all(got[i] == (None, "block") for i in range(50)) and got[50] == (None, "allow") and got[51] == (None, "block") and got[52] == ("com/", "allow")
    assert all(got[i] == (None, "allow") for i in range(53, len(urls)))


def test_secrets_of_any_length(spark):
    signs = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0z+"
    df = spark.createDataFrame([(n, "token " + (signs * (n // 32 + 1))[:n]) for n in (19, 20, 100, 150, 5_000, 300_000)], "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans if s["kind"] == "secret"] for r in pii.find_pii(df, into="spans").collect()}
    assert got == {19: [], **{n: [(6, 6 + n)] for n in (20, 100, 150, 5_000, 300_000)}}


def test_mask(spark):
    df = spark.createDataFrame([(1, "é mail a@b.cd or 1.2.3.4 end"), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask_pii(pii.find_pii(df)).collect()}
    assert got == {1: "é mail [EMAIL] or [IP] end", 2: "plain", 3: None}


def test_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/1?x", "http://example.com/en/", "http://a.example.com/en", "https://b.net/fr/2#t", "http://casino-x.example.org/a",
            "http://org", "http://example.com?x", "a://b://c.net/es/", "http://xcom/", "http://example.com/en/", "http://" + "a." * 3000 + "net/es/" + "p/" * 3000]
    want = [("", "", None, "allow")] * 3 + [("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("a.example.com", "/en", "com/", "allow"), ("b.net", "/fr/2", "net/fr/", "block"), ("casino-x.example.org", "/a", None, "block"), ("org", "", None, "allow"), ("example.com", "", None, "allow"), ("b:", "//c.net/es/", None, "allow"), ("xcom", "/", None, "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("a." * 3000 + "net", "/es/" + "p/" * 3000, "net/es/", "block")]
    df = spark.createDataFrame([(i, u, "h", "z") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op2_url_filters(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == want
    assert url_filter.judge_urls(df.limit(0), url_filter.rule_table(spark)).count() == 0
