import math
import random
import re

from pyspark.sql import functions as F

from thicket.llm import url_filter as U
from thicket.llm.quality_rules import QualityModel
from thicket.llm.queries import labelled_urls, op3_url_filter

SCHEMA = "page_id long, url string, bad boolean"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return fold, re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


def rule_of(host, path):
    fits = [(h + p, a) for h, p, a in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def brute(rows):
    shapes = {}
    for _, url, bad in rows:
        host, path = split(url)
        if host:
            s = shapes.setdefault((host, re.sub("[0-9]+", "#", path)), [0, 0, 0])
            s[0] += 1
            s[1] += bad is not None
            s[2] += bool(bad)
    segs = {k: re.sub("^/", "", k[1]).split("/", U.DEPTH - 1) for k in shapes}
    template = {k: () for k in shapes}
    for d in range(U.DEPTH):
        children, parents = {}, {}
        for k, (n, lab, bad) in shapes.items():
            if d < len(segs[k]):
                c = children.setdefault((k[0], template[k], segs[k][d]), [0, 0, 0])
                for i, x in enumerate((n, lab, bad)):
                    c[i] += x
        for (h, t, _), c in children.items():
            p = parents.setdefault((h, t), [0, 0, 0, 0])
            p[0] += 1
            for i, x in enumerate(c):
                p[i + 1] += x
        name = {}
        for (h, t, s), (n, lab, bad) in children.items():
            branches, all_, L, B = parents[h, t]
            rest = L - lab
            similar = True
            if lab and rest:
                p = B / L
                se = math.sqrt(p * (1 - p) * (1 / lab + 1 / rest))
                similar = se == 0 or abs(bad / lab - (B - bad) / rest) < U.Z * se
            name[h, t, s] = "*" if similar or (branches > U.BRANCHES and n < U.SUPPORT * all_) else s
        template = {k: t + (name[k[0], t, segs[k][d]],) if d < len(segs[k]) else t for k, t in template.items()}
    lab, bad = (sum(v[i] for v in shapes.values()) for i in (1, 2))
    base = 1 - bad / lab if lab else 1.0
    leaves = {}
    for k, v in shapes.items():
        x = leaves.setdefault((k[0], template[k]), [0, 0])
        x[0] += v[1]
        x[1] += v[2]
    low = {k for k, (n, b) in leaves.items() if (n - b + U.PRIOR * base) / (n + U.PRIOR) < U.PURITY}
    out = []
    for page, url, _ in rows:
        host, path = split(url)
        rule, action = rule_of(host, path)
        key = host, re.sub("[0-9]+", "#", path)
        own = "block" if host and (host, template[key]) in low else "allow"
        out.append((page, host, path, rule, action or own))
    return sorted(out, key=str)


ODD = [(1, None, None), (2, "nothing", True), (3, "://", None), (4, "HTTP://WWW.Example.COM/en/1?x#y", False), (5, "a://com", None), (6, "a://com/", None), (7, "x://net?/es/", None), (8, "x://É.net/fr/a://b", None), (None, "x://h.org//a//b/", True), (9, "x://h.org/a\nb/c?d", None), (9, "x://notcom/en/", None), (10, "x://h.org/" + "d/" * 40, True)]


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = list(ODD)
    for i in range(1500):
        host = rng.choice(["a.org", "b.org", "spam.org", "www.example.com", "x.example.com", "q.net"])
        top = rng.choice(["en", "de", "tag", "buy"])
        tail = rng.choice([f"{rng.randrange(99)}.html", f"n{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdefgh')}", "", f"x/{rng.randrange(9)}/y"])
        bad = rng.random() < (0.9 if host == "spam.org" and top == "buy" else 0.8 if host == "b.org" and "html" in tail else 0.1)
        rows.append((100 + i, f"http://{host}/{top}/{tail}", bad if rng.random() < 0.8 else None))
    got = sorted((tuple(r) for r in U.filter_urls(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str)
    want = brute(rows)
    assert got == want
    assert sum(r[4] == "block" and r[3] is None for r in want) > 100


def test_text_and_label_of_a_page(spark):
    html = "<html><head><title>no</title></head><nav><a>menu</a></nav><!-- <p>x</p> --><p>One <b>two</b></p><div>three<br/>four</div><script>var t='</p>';</script>"
    out = spark.createDataFrame([(1, html), (2, None), (3, "")], "i int, html string").select("i", U.page_text(F.col("html")).alias("t")).collect()
    got = {r.i: r.t and [" ".join(x.split()) for x in r.t.split("\n") if x.strip()] for r in out}
    assert got == {1: ["One two", "three", "four"], 2: None, 3: ""}
    good = " ".join(f"plain{i} words{i} follow" for i in range(40))
    docs = spark.createDataFrame([(i, f"{good} {i}") for i in range(30)] + [(99, "zq### " * 300)], "doc_id long, text string")
    model = QualityModel(docs, spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int"))
    rows = spark.createDataFrame([(1, good, "u"), (2, "two words", "u"), (3, None, "u"), (4, "zq### " * 40, None)], "page_id long, text string, url string")
    assert {r.page_id: r.bad for r in model.labelled(rows, "text").collect()} == {1: False, 2: True, 3: None, 4: True}


def test_other_columns_are_ignored(spark):
    rows = [(i, f"http://h.org/a/{i}", i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1, 2.0, None) for r in rows], SCHEMA + ", host string, n int, verdict double, template string")
    assert sorted((tuple(r) for r in U.filter_urls(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert U.filter_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in labelled_urls(spark, d).collect()]
    assert len(rows) == spark.read.parquet(f"{d}/pages.parquet").count() and {r[2] for r in rows} == {True, False}
    assert sorted((tuple(r) for r in op3_url_filter(spark, d).collect()), key=str) == brute(rows)


def test_a_rare_branch_that_surely_differs_is_kept(spark):
    def pages(host, odd_is_bad):
        return [(f"http://{host}/d{chr(97 + k)}/{i}", (k == 3) == odd_is_bad) for k in range(U.BRANCHES + 4) for i in range(40)]

    # One bad directory of many clean ones, one clean of many bad ones, and single pages whose labels prove nothing.
    urls = pages("wide.org", True) + pages("worse.org", False) + [(f"http://one.org/{chr(97 + k)}{chr(97 + j)}", k == j == 0) for k in range(10) for j in range(10)]
    rows = [(i, url, bad) for i, (url, bad) in enumerate(urls)]
    by_page = {r[0]: r[4] for r in U.filter_urls(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    verdict = {url: by_page[i] for i, (url, _) in enumerate(urls)}
    assert all(v == ("block" if "/dd/" in u else "allow") for u, v in verdict.items() if "wide.org" in u)
    assert all(v == ("allow" if "/dd/" in u else "block") for u, v in verdict.items() if "worse.org" in u)
    assert all(v == "allow" for u, v in verdict.items() if "one.org" in u)
