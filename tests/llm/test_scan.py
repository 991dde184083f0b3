"""License scan and URL reputation against brute force."""

import random
import re

import pytest

from weftmix.llm import license_scan, license_texts, url_reputation

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_scan(texts):
    """Every template at every offset, overhanging ones too; no index."""
    out = []
    for d in map(words, texts):
        base = [(label, i) for label, p in license_scan.BASE for i in range(len(d)) if d[i:i + len(p.split())] == p.split()]
        found = []
        for t in license_scan.TEMPLATES:
            own = words(t.text)
            spots = [(i, words(k)) for k in t.keys for i in range(len(own)) if own[i:i + len(words(k))] == words(k)]
            assert len(spots) == len(t.keys)  # each phrase once in its text
            for at in range(-len(own), len(d)):
                if all(at + i >= 0 and d[at + i:at + i + len(k)] == k for i, k in spots):
                    same = sum(0 <= at + i < len(d) and d[at + i] == w for i, w in enumerate(own))
                    found.append((t.label, at, same / len(own)))
        out.append((len(d), sorted(base), sorted(found)))
    return out


def test_license_scan_matches_brute_force(spark, docs):
    r = random.Random(3)

    def fill(n):
        return " ".join(r.choice("foo bar the of license version use é1 in 2 public all".split()) for _ in range(n))
    notices = ["Licensed under the Apache License, Version 2.0.", "licensed under a apache license version 2.0", "Apache License",
               "This work is licensed under the GNU General Public License, version 3.", "General Public License", "Licensed under CC BY-NC 4.0.",
               "CC BY", "cc-by cc by cc by", "Released under the MIT License.", "the MIT License", "All rights reserved.", "all RIGHTS\nreserved all rights reserved",
               license_texts.MIT.replace("granted", "given"), license_texts.GNU.format(name="Lesser General Public License", version="2.1")]
    notices += [t.text for t in license_scan.TEMPLATES]
    texts = [f"{fill(r.randint(0, 30))} {n} {fill(r.randint(0, 30))}" for n in notices for _ in range(2)] + notices
    edited = [n.split() for n in notices if len(n) > 200]
    texts += [" ".join(w for w in n if r.random() > 0.02) for n in edited] + [" ".join(n[len(n) // 5:]) for n in edited] + [" ".join(n[:len(n) // 2]) for n in edited]
    texts += [None, "", " . ", "cc", "by", "cc\u0080by", "Ünder", "license " * 3000, "mit license " * 500, fill(5000) + notices[0] + fill(5000)] + [fill(40) for _ in range(20)]
    got = license_scan.scan(docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    have = [(x["n_words"], sorted(map(tuple, x["base"])), sorted(map(tuple, x["found"]))) for x in got]
    assert have == brute_scan(texts)
    assert {f[0] for _, _, found in have for f in found} == {t.label for t in license_scan.TEMPLATES}


def test_license_scan_finds_every_key_phrase(spark, docs):
    # a key phrase alone, at an end of the text or inside it, has its label
    lines = {"Apache License Version 2.0": "apache-2.0", "MIT License": "mit", "this file uses the MIT License terms": "mit",
             "under the Mozilla Public License, v. 2": "mpl-2.0", "CC BY-SA 4": "cc-by-sa-4.0"}
    got = license_scan.scan(docs(list(enumerate(lines)))).orderBy("doc_id").collect()
    assert [[f["label"] for f in x["found"]] for x in got] == [[label] for label in lines.values()]
    assert all(0 < f["share"] <= 1 for x in got for f in x["found"])


def test_license_scan_edges(spark, docs):
    got = license_scan.scan(docs([(1, "CC BY"), (1, "CC BY"), (None, None)])).collect()
    assert sorted((x["doc_id"] or 0, x["n_words"], len(x["base"]), len(x["found"])) for x in got) == [(0, 0, 0, 0), (1, 2, 1, 0), (1, 2, 1, 0)]
    assert license_scan.scan(docs([])).collect() == []


URLS = ["http://Example.org/es/1", "https://a.example.org/en/12?q#f", "http://x.org/en/2", "http://x.org", "http://xorg/es/", "http://b.co.uk/fr/1",
        "http://shop.com/fr/1", "http://shop.com/de/1?x=/fr/", "http://shop.com/en/2", "http://SHOP.com:80/fr/", "ftp://y.net/a#/b", "no scheme/x",
        "http://", "://h.org/p", "http://a://b.org/c", "http://é.org/É?", None, "", "http://q.com?x/fr/", "http://org/x"]


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in url_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, None))


def brute_reputation(rows):
    """host -> (mean, low, high) by the same model, level by level."""
    n, k = {}, {}
    for host, _, _, v in rows:
        n[host] = n.get(host, 0) + (v is not None)
        k[host] = k.get(host, 0) + (v == "allow")

    def split(host):
        parts = host.split(".")
        two = ".".join(parts[-2:])
        return (two, ".".join(parts[-3:])) if two in url_reputation.TWO_LABEL_SUFFIXES else (parts[-1], two)

    def total(keys):
        out = {}
        for h, key in keys.items():
            a, b = out.get(key, (0, 0))
            out[key] = (a + n[h], b + k[h])
        return out

    def strength(units):
        over = sum((b - a * m) ** 2 - a * m * (1 - m) for a, b, m in units)
        base = sum(a * (a - 1) * m * (1 - m) for a, _, m in units)
        rho = min(0.999, max(0.001, over / base if base else 0.999))
        return 1 / rho - 1
    suffixes = total({h: split(h)[0] for h in n})
    domains = total({h: split(h) for h in n})
    p0 = (sum(k.values()) + 1) / (sum(n.values()) + 2)
    s1 = strength([(a, b, p0) for a, b in suffixes.values()])
    ms = {x: (s1 * p0 + b) / (s1 + a) for x, (a, b) in suffixes.items()}
    s2 = strength([(a, b, ms[x[0]]) for x, (a, b) in domains.items()])
    md = {x: (s2 * ms[x[0]] + b) / (s2 + a) for x, (a, b) in domains.items()}
    s3 = strength([(n[h], k[h], md[split(h)]) for h in n])
    out = {}
    for h in n:
        a, b = s3 * md[split(h)] + k[h], s3 * (1 - md[split(h)]) + n[h] - k[h]
        mean, sd = a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        out[h] = (mean, mean - url_reputation.Z * sd, mean + url_reputation.Z * sd)
    return out


def test_url_judgement_matches_brute_force(spark):
    r = random.Random(1)
    urls = URLS + [f"http://{r.choice(['m.', ''])}d{r.randint(0, 5)}.{r.choice(['com', 'org', 'net', 'co.uk'])}/{r.choice(['de', 'de', 'fr', 'en'])}/{i}" for i in range(300)]
    urls += ["http://bad.com/de/1"] * 40 + ["http://bad.com/en/1"] * 3
    pages = spark.createDataFrame([(i, u, "h", "clash", 0.5) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, mean double")
    got = {x["page_id"]: x for x in url_reputation.judge_urls(pages).collect()}
    rows = [brute_rule(u) for u in urls]
    rep = brute_reputation(rows)
    assert len(got) == len(urls)
    for i, (host, path, rule, verdict) in enumerate(rows):
        x = got[i]
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule)
        assert (x["mean"], x["low"], x["high"]) == pytest.approx(rep[host])
        assert x["verdict"] == (verdict or ("block" if rep[host][2] < url_reputation.MIN_RATE else "allow"))
    assert got[len(urls) - 1]["rule"] is None and got[len(urls) - 1]["verdict"] == "block"


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "http://z.net/a"), (1, "http://z.net/a"), (None, None)], "page_id long, url string")
    assert [x["verdict"] for x in url_reputation.judge_urls(pages).collect()] == ["allow"] * 3
    assert url_reputation.judge_urls(pages.limit(0)).collect() == []
