"""Verdicts on addresses against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barometry.llm import url_filter as urls

SCHEMA = "page_id long, url string"


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path, rules):
    best = None
    for verdict, rule in rules:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return best


def plain_segments(path, depth):
    parts = [p for p in path.split("/") if p]
    out = []
    for part in parts:
        ending = re.search(r"\.[A-Za-z]{1,5}\Z", part)
        out.append("*" + (ending[0] if ending else "") if re.search("[0-9]", part) else part)
    return tuple(out[:depth] + ["**"] * (len(out) > depth))


def plain_verdicts(rows, rules, depth):
    """Rows one by one, trees as dictionaries."""
    parsed = []
    for page_id, url in rows:
        host, path = plain_parse(url)
        parsed.append((page_id, host, path, plain_rule(host, path, rules), plain_segments(path, depth)))
    template = {(host, segments): "" for _, host, _, _, segments in parsed}
    for level in range(depth + 1):
        stats, shapes = defaultdict(Counter), defaultdict(Counter)
        for _, host, _, rule, segments in parsed:
            if len(segments) > level:
                parent = host, template[host, segments]
                shape = "/".join(s if s.startswith("*") else "a" for s in segments[level + 1 :])
                for node in (parent, (*parent, segments[level])):
                    stats[node].update(n=1, labelled=rule is not None, blocked=rule is not None and rule[2] == "block")
                    shapes[node][shape] += 1
        children = Counter(node[:2] for node in stats if len(node) == 3)
        stands = {}
        for node in (node for node in stats if len(node) == 3):
            own, every = stats[node], stats[node[:2]]
            freedom = len(shapes[node[:2]]) - 1
            chi = sum(o * o / (own["n"] * shapes[node[:2]][s] / every["n"]) for s, o in shapes[node].items()) - own["n"]
            rate = (every["blocked"] + 1) / (every["labelled"] + 2)
            off = own["blocked"] - own["labelled"] * rate
            if node[2].startswith("*"):
                stands[node] = node[2]
            elif children[node[:2]] > urls.MANY and own["n"] * urls.MANY < every["n"]:
                stands[node] = "*"
            elif children[node[:2]] > 1 and chi <= freedom + 3 * math.sqrt(2 * freedom) + 1e-6 and off * off <= 9 * own["labelled"] * rate * (1 - rate):
                stands[node] = "+"
            else:
                stands[node] = node[2]
        for host, segments in template:
            if len(segments) > level:
                template[host, segments] += "/" + stands[host, template[host, segments], segments[level]]
    counts = defaultdict(Counter)
    for _, host, _, rule, segments in parsed:
        counts[host, template[host, segments]].update(allow=rule is not None and rule[2] == "allow", all=rule is not None)
    out = []
    for page_id, host, path, rule, segments in parsed:
        if rule:
            out.append((page_id, host, path, rule[1], rule[2], None, None))
        else:
            name = template[host, segments]
            purity = (counts[host, name]["allow"] + 1) / (counts[host, name]["all"] + 2)
            out.append((page_id, host, path, None, "block" if purity < 0.5 else "allow", name, purity))
    return sorted(out, key=str)


def made_up(seed):
    random.seed(seed)
    rows = []
    for i in range(1500):
        host = random.choice(["a.example.net", "a.example.net", "b.example.net", "x.org", "Y.example.com", "www.example.com", "net", "shop.net"])
        first = random.choice(["en", "de", "es", "fr", "es", f"name{chr(97 + i % 26)}"])
        end = random.choice(["", "/", f"/{i}", f"/{i}.html", f"/v{i}/comments", f"/{'ab'[i % 2]}/c/" + "/".join("defghijk")])
        if host == "shop.net" and random.random() < 0.5:
            first, end = "fr", f"/{i}.php"
        rows.append((i, f"http://{host}/{first}{end}{random.choice(['', '?q=/x', '#t'])}"))
    odd = [None, "", "no scheme", "://", "x://", "ftp://HOST.Com", "http://com/", "http://com", "http://a.net?x=/es/", "http://net/es/é/1\n2", "a://b://c/d", "https://xcom/"]
    return rows + [(None, url) for url in odd] + rows[:40] + [(i, "http://long.net/" + "/".join("ab" * 3000)) for i in range(3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_python(spark, seed):
    rows = made_up(seed)
    found = urls.judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(6))
    expected = plain_verdicts(rows, urls.RULES, urls.DEPTH)
    found = sorted((tuple(row) for row in found.collect()), key=str)
    assert [x[:6] for x in found] == [x[:6] for x in expected]
    assert [x[6] for x in found] == pytest.approx([x[6] for x in expected])
    assert {x[4] for x in found if x[3] is None} == {"allow", "block"}


def test_varying_segments_and_like_branches_share_a_template(spark):
    rows = [(i, f"http://x.net/{lang}/{i}") for i in range(80) for lang in ("en", "es")]
    rows += [(i, f"http://y.org/user/{chr(97 + i % 26)}{chr(97 + i // 26)}/photos") for i in range(60)]
    found = {(r.host, r.template, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {("x.net", "/+/*", "block"), ("x.net", None, "block"), ("y.org", "/user/*/photos", "allow")}


def test_empty_table_and_clashing_names(spark):
    assert urls.judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []
    names = ["host", "path", "rule", "verdict", "segments", "n", "template", "shape", "found"]
    wide = spark.createDataFrame([(1, "http://a.net/x")], SCHEMA).withColumns({name: F.lit("y") for name in names})
    assert [tuple(row) for row in urls.judge_urls(wide).collect()] == [(1, "a.net", "/x", None, "allow", "/x", 0.5)]
