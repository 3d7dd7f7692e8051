"""The native text operators against plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import oracle, pii, quality, queries, secrets, urls
from tests.llm.fixtures import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, sf_dir):
    return documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000))


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    covered = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_equals_brute_force(spark, sf_dir):
    rows = quality.quality(corpus(spark, sf_dir)).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text), r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_agrees_with_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    got = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    c = {(r.quality, r.kept): r["count"] for r in got.filter("n_words >= 20").groupBy("quality", "kept").count().collect()}
    assert c.get((1, True), 0) >= 0.97 * (c.get((1, True), 0) + c.get((1, False), 0))
    assert c.get((0, False), 0) >= 0.98 * (c.get((0, True), 0) + c.get((0, False), 0))


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string, n_words string")
    out = quality.quality(empty)
    assert out.count() == 0 and out.columns.count("kept") == 1 and dict(out.dtypes)["n_words"] == "bigint"
    rule = (quality.Threshold("long_words", "word_chars", "n_words", None, 2.0),)
    one = quality.quality(spark.createDataFrame([(1, "abc " * 30)], "doc_id long, text string"), rules=rule).first()
    assert one.broken_rules == ["long_words"] and not one.kept


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    t = text or ""
    out = []
    for o, (kind, p) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), o, m.end(), kind))
    return sorted(out)


def brute_secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


@pytest.mark.parametrize("module,brute", [(pii, brute_pii), (secrets, brute_secrets)])
def test_base_spans_equal_brute_force(spark, sf_dir, module, brute):
    for r in module.scan(corpus(spark, sf_dir)).withColumn("sha", module.digest(F.col("base_spans"))).collect():
        want = brute(r.text)
        assert [(x.s, x.o, x.e, x.k) for x in r.base_spans] == want, (r.doc_id, (r.text or "")[:200])
        assert r.sha == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()
        assert {tuple(x) for x in r.base_spans} <= {tuple(x) for x in r.spans}
        assert all(x.m == r.text[x.s : x.e] for x in r.spans)


def test_methods_add_spans_and_leave_prose_alone(spark):
    d = {r.doc_id: [(x.k, x.m) for x in r.spans] for r in pii.scan(documents(spark, False)).collect()}
    assert ("national_id", "123-45-6789") in d[12] and ("phone", "(030) 555-1234") in d[12] and any(k == "account" for k, _ in d[12]) and any(k == "email" for k, _ in d[12])
    assert not any("2024" in m for _, m in d[12])
    s = {r.doc_id: [(x.k, x.m) for x in r.spans] for r in secrets.scan(documents(spark, False)).collect()}
    assert s[15] == [("entropy", "Zm9vYmFyQmF6MTIzNDU2Nzg5MHF3ZXJ0eXVpb3A=")]


def test_allowed_words_do_not_hide_a_key_beside_them(spark):
    key = "q7Rk2ZpX9vLw4TnB8sYc1HdJ6mGf3AeU5oKi0WxN"
    found = [f"sample_key={key}", f"docs/example/{key}", f"{key}_placeholder"]
    left = ["sample_key=abc123", "docs/example/some/long/path/number/12", "example-0123456789-abcdefghijkl", "placeholder_placeholder_1"]
    docs = spark.createDataFrame(list(enumerate(found + left)), "doc_id long, text string")
    got = {r.doc_id: [(x.k, x.m) for x in r.spans] for r in secrets.scan(docs).collect()}
    assert [got[i] for i in range(len(found + left))] == [[("entropy", t)] for t in found] + [[]] * len(left)


def brute_added_pii(text):
    """All candidates by plain patterns, scored by walking the trees; the highest scores first."""
    t, base = text or "", brute_pii(text)
    trees, least = pii.model()
    got = []
    for kind, pattern in pii.GENERATORS:
        for m in re.finditer(pattern, t):
            x = (m.start(), pii.KINDS.index(kind), m.end(), kind)
            v = pii.score_of(trees, pii.features_of(m.group(), t[max(0, m.start() - pii.CONTEXT) : m.start()]))
            if v >= least[kind] and not any(y[0] < x[2] and x[0] < y[2] for y in base):
                got.append((-v, *x))
    out = []
    for _, *x in sorted(got):
        if not any(y[0] < x[2] and x[0] < y[2] for y in out):
            out.append(tuple(x))
    return out


def brute_added_secrets(text):
    """All candidates by plain patterns, each part's best window counted anew."""
    t, base, out = text or "", brute_secrets(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
        def hot(part):
            least = next((bits for _, p, bits in secrets.CLASSES if re.search(p, part)), 99)
            return len(part) >= secrets.WINDOW and not any(re.search(p, part) for p in secrets.ALLOWED) and entropy_brute(part) >= least - 1e-12
        if any(map(hot, re.split(secrets.ALLOWED_WORDS, m.group()))) and not any(y[0] < m.end() and m.start() < y[2] for y in base):
            out.append((m.start(), 3, m.end(), "entropy"))
    return out


PLANTED = [
    "write to jane dot doe at gmail dot com today", "Fax: 01632 960 001 or tel 06 12 34 56 78", "invoice 2023-555-1234 of 2024-01-02 costs 12.345.678", "phone 030 1234 5678 SSN 123-45-6789 part AB12CDEFGHIJKLMN",
    "look at this dot matrix", "call 555-123-4567, mail bob [at] site [dot] org; iban DE44 5001 0517 5407 3249 31", "mobile: 0171/555 1234 0171/555 1234",
    "ghp_16C7e42F292c6912E7710c838347Ae178B4a and q7Rk2ZpX9vLw4TnB8sYc1HdJ6mGf3AeU5oKi0WxN", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1 Donaudampfschifffahrtsgesellschaftskapitaen 123e4567-e89b-12d3-a456-426614174000",
]


@pytest.mark.parametrize("module,brute", [(pii, brute_added_pii), (secrets, brute_added_secrets)])
def test_added_spans_equal_brute_force(spark, sf_dir, module, brute):
    planted = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(PLANTED)], "doc_id long, text string")
    added = 0
    for r in module.scan(corpus(spark, sf_dir).select("doc_id", "text").unionByName(planted)).collect():
        had = {tuple(x) for x in r.base_spans}
        got = sorted((x.s, x.o, x.e, x.k) for x in r.spans if tuple(x) not in had)
        assert got == sorted(brute(r.text)), (r.doc_id, (r.text or "")[:200])
        added += len(got)
    assert added >= 3


def test_planted_cases(spark):
    docs = spark.createDataFrame(list(enumerate(PLANTED)), "doc_id long, text string")
    d = {r.doc_id: [x.m for x in r.spans] for r in pii.scan(docs).collect()}
    assert d[0] == ["jane dot doe at gmail dot com"] and d[1] == ["01632 960 001", "06 12 34 56 78"] and d[2] == d[4] == [] and len(d[5]) == 3
    s = {r.doc_id: [x.m for x in r.spans] for r in secrets.scan(docs).collect()}
    assert len(s[7]) == 2 and s[8] == []


def test_pii_model_on_held_out_formats():
    """Recall and precision by kind on rows of another seed."""
    trees, least = pii.model()
    rows = pii.training_rows(4000, seed=99)
    for kind in least:
        own = [(pii.score_of(trees, x) >= least[kind], y) for k, x, y in rows if k == kind]
        hit, wrong, all_ = sum(g and y for g, y in own), sum(g and not y for g, y in own), sum(y for _, y in own)
        assert hit >= 0.95 * (hit + wrong), kind
        print(kind, round(hit / all_, 3), round(hit / max(1, hit + wrong), 3))


def test_prose_of_the_sample_gets_no_added_spans(spark, sf_dir):
    """The sample's documents hold base kinds only; the prose around them must not be taken for more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert secrets.scan(docs).filter("size(spans) > size(base_spans)").count() == 0
    assert pii.scan(docs).filter("size(spans) > size(base_spans)").count() == 0


@pytest.mark.parametrize("run", [pii.scan, secrets.scan, quality.quality, secrets.redact, pii.redact])
def test_columns_of_any_name_and_empty_tables(spark, run):
    names = ["__w", "__all", "__more", "__email", "__lines", "__win", "n.dot", "__base"]
    df = documents(spark, False).select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    plain = run(documents(spark, False).select("doc_id", "text"))
    out = run(df)
    assert [c for c in out.columns if c not in plain.columns] == names
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert run(df.limit(0)).count() == 0


def test_redaction(spark):
    out = {r.doc_id: r.text for r in secrets.redact(documents(spark, False)).collect()}
    assert out[0] is None and out[3] == "one" and out[16] == "ünïcödé 😀 <ASSIGN> 😀 user@exämple.com me@example.org"
    assert "4c14c50d" not in out[13]
    mail = {r.doc_id: r.text for r in pii.redact(documents(spark, False)).collect()}
    assert mail[16].endswith("me@example.org".replace("me@example.org", "<EMAIL>"))


def entropy_brute(s, w=20):
    from math import log2

    return max((sum(-c / w * log2(c / w) for c in Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1)), default=0.0)


def test_window_entropy(spark):
    for s in ("abcdefghijklmnopqrstuvwxyz0123456789", "a" * 25, "ab" * 30 + "qwertyuiop", "short"):
        got = spark.range(1).select(secrets.entropy(F.lit(s))).first()[0]
        assert got == pytest.approx(entropy_brute(s), abs=1e-9)


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


def test_urls_equal_brute_force(spark, sf_dir):
    rules = [*queries.URL_RULES, ("allow", "a.example.com", "/en/70"), ("block", "example.com", "/en/70/x"), ("block", "uk", "")]
    rows = [(i, u) for i, u in enumerate([
        None, "", "nohost", "http://", "HTTP://EXAMPLE.COM/en/7", "http://xexample.com/en/7", "http://www.Example.com/en/70?x#y", "http://a.example.com/en/70/x/y", "https://b.a.example.com/en/70/x", "http://example.com?/en/7",
        "http://example.net/de/8a", "http://example.net/de/", "http://net/de/8", "ftp://x.co.uk", "http://x://y/en/7", "http://com/en/", "http://com/en", "a://é.com/en/\nq", "http://example.com/en/7/../%20 é",
        "http://com/en/\U0010ffffx", "http://com/en/\U0010fffe\U0010ffff", "http://a.\U0010ffff.com/en/",
    ])]
    df = spark.createDataFrame(rows + [(99, "http://www.example.com/en/70"), (99, "http://www.example.com/en/70")], "page_id long, url string")
    df = df.unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    for r in urls.filter_urls(df, urls.rule_table(spark, rules), salts=4).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url, rules), r.url
    odd = urls.filter_urls(df.select("page_id", "url", F.lit(1).alias("__rule"), F.lit(2).alias("n.dot")), urls.rule_table(spark, rules))
    assert odd.columns == ["page_id", "url", "__rule", "n.dot", "host", "path", "rule", "verdict"] and odd.count() == df.count()
    empty = spark.createDataFrame([], "page_id long, url string, host string")
    assert urls.filter_urls(empty, urls.rule_table(spark, rules)).count() == 0


def test_url_query_follows_the_rules_of_its_contract(spark, tmp_path):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    hosts, paths = ["com", "example.com", "www.example.com", "net", "a.net", "example.net", "www.example.net", "org", "example.org"], ["/en/", "/en/7", "/de/", "/de/8", "/es/", "/"]
    rows = list(enumerate(f"http://{h}{p}" for h in hosts for p in paths))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    want = [(i, *brute_url(u, rules)) for i, u in rows]
    assert sorted(tuple(r) for r in queries.op5_url_filters(spark, str(tmp_path)).collect()) == want
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(duck.sql(oracle.ORACLE["op5_url_filters"]).fetchall()) == want
